"""Clusters of postings that are one job: exact keys, addresses, and texts within a block of employer and title head."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.components import connected_components

#: Characters below which a fingerprint says nothing and the whole title decides.
FINGERPRINT_CHARS = 400
#: Differing bits up to which fingerprints are alike, and postings up to which an address identifies a job.
MOST_BITS, MOST_PER_URL = 3, 8
CLUSTERS = "ingest_id long, cluster long, n_members long, canonical_id long, reason string"


def _groups(*keys: pd.Series) -> list[np.ndarray]:
    """Positions of the rows of each key with more than one, in the order in which the keys appear; rows with a null key in none."""
    at = pd.DataFrame(dict(enumerate(keys))).dropna()
    found = at.groupby(list(at.columns), sort=False).indices.values()
    rows = at.index.to_numpy()
    return sorted((np.sort(rows[x]) for x in found if len(x) > 1), key=lambda x: x[0])


def cluster_members(rows: pd.DataFrame, bits: int = MOST_BITS, chars: int = FINGERPRINT_CHARS) -> pd.DataFrame:
    """CLUSTERS of candidates that may meet, merged in the order of their ingest_id.

    The order counts, as a cluster that has a place takes no posting of another place by its text. The place that is kept at a merge is
    the one noted for the first posting, else for the second, so a chain of merges may lose it, as in the rules that this follows.
    """
    rows = rows.sort_values("ingest_id", ignore_index=True)
    n = len(rows)
    root, size, reason = np.arange(n), np.ones(n, int), [""] * n
    place = np.where(rows["location"] == "", 0, pd.factorize(rows["location"])[0] + 1)
    source, title = (pd.factorize(rows[c])[0] for c in ("source", "title"))
    short, prints = (rows["len"] < chars).to_numpy(), rows["print"].to_numpy(np.int64).view(np.uint64)

    def merge(a: int, b: int, why: str) -> None:
        keep, gone = root[a], root[b]
        if keep == gone:
            return
        if size[keep] < size[gone]:
            keep, gone = gone, keep
        root[root == gone] = keep
        size[keep] += size[gone]
        place[keep] = place[a] or place[b]
        reason[b], reason[a] = reason[b] or why, reason[a] or why

    for groups, why in ((_groups(rows["source"], rows["external_id"]), "exact_key"), (_groups(rows["url_group"]), "canonical_url")):
        for at in groups:
            for b in at[1:]:
                merge(at[0], b, why)
    for block in _groups(rows["company"], rows["head"]):
        for i, a in enumerate(block):
            rest = block[i + 1 :]
            by_title = short[rest] | short[a]
            alike = np.where(by_title, title[rest] == title[a], np.bitwise_count(prints[rest] ^ prints[a]) <= bits)
            rest = rest[alike & (source[rest] != source[a])]
            while len(rest := rest[root[rest] != root[a]]):
                own, other = place[root[a]], place[root[rest]]
                open_to = np.flatnonzero((own == 0) | (other == 0) | (own == other))
                if not len(open_to):
                    break
                b = rest[open_to[0]]
                merge(a, b, "title_exact" if short[a] or short[b] else "simhash")
                rest = rest[open_to[0] + 1 :]

    out = rows.assign(root=root, reason=[r or "singleton" for r in reason], far=~rows["native"], less=-rows["len"])
    of = out.groupby("root")["ingest_id"]
    best = out.sort_values(["far", "less", "posted_us", "ingest_id"]).groupby("root")["ingest_id"].first()
    return out.assign(cluster=of.transform("min"), n_members=of.transform("size"), canonical_id=out["root"].map(best))[["ingest_id", "cluster", "n_members", "canonical_id", "reason"]]


def _stars(posts: DataFrame, keys: list[str], which: Column) -> DataFrame:
    """(src, dst, keys): the smallest posting of each key and all of its postings, for keys of which `which` holds over n and mixed."""
    every = posts.dropna(subset=keys).groupBy(*keys).agg(F.min("ingest_id").alias("src"), F.count(F.lit(1)).alias("n"), (F.min("source") != F.max("source")).alias("mixed")).filter(which)
    return posts.join(every, keys).select("src", F.col("ingest_id").alias("dst"), *keys)


def cluster_postings(posts: DataFrame, most_per_url: int = MOST_PER_URL) -> DataFrame:
    """CLUSTERS of every row of `posts`: ingest_id, source, external_id, url_key, company, title, head, location, len, print, native, posted_us.

    Rows of one source with the same id are one job, and so are rows that share an address which at most `most_per_url` rows have. Rows of
    different sources are, if company and head agree and their places don't differ, when their fingerprints are alike or, where either text
    is short, when their titles are the same. Everything that can meet, blocks of several sources whole, is brought into one component and merged
    there in order; blocks of one source are never brought together. The canonical row is a native one if there is any, then the longest, then the earliest.
    """
    by_url = _stars(posts, ["url_key"], F.col("n").between(2, most_per_url))
    edges = [_stars(posts, ["source", "external_id"], F.col("n") > 1), by_url, _stars(posts, ["company", "head"], F.col("mixed"))]
    groups = connected_components(reduce(DataFrame.unionByName, [e.select("src", "dst") for e in edges])).withColumnRenamed("node", "ingest_id")
    members = posts.join(groups, "ingest_id").join(by_url.select(F.col("dst").alias("ingest_id"), F.col("src").alias("url_group")), "ingest_id", "left")
    tasks = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as AQE would join partitions of few bytes and much work
    met = members.repartition(tasks, "component").groupBy("component").applyInPandas(lambda rows: cluster_members(rows), CLUSTERS)
    own = F.col("ingest_id")
    lone = posts.join(groups, "ingest_id", "left_anti").select("ingest_id", own.alias("cluster"), F.lit(1).cast("long").alias("n_members"), own.alias("canonical_id"), F.lit("singleton").alias("reason"))
    return met.unionByName(lone)
