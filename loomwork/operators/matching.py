"""Retrieval, fusion, reranking and presentation of ranked lists, for all queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.joins import BROADCAST_ROWS, lookup_filter
from loomwork.session import materialize


def words(col: Column) -> Column:
    """Lower-case runs of letters and digits; an empty array for null."""
    return F.filter(F.split(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def top_k(scored: DataFrame, group: str, score: str, tie: str, k: int, rank: str = "rank") -> DataFrame:
    """The k best rows of each group by score, ties by `tie`, with their rank from 1.

    Spark pushes the limit below the shuffle (a group limit a partition), so a group with very many rows moves k a task.
    """
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie).asc())
    return scored.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def query_postings(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, word, length, tf): occurrences of the words of `wanted` (query, word) in each document of `length` words.

    Words that no query has are left out before anything is shuffled, and rows are placed by document, so that sums over a
    document need no further shuffle. Null and wordless texts have no rows; rows of one id and length add up.
    """
    split = docs.select(F.col(doc_id).alias("doc"), words(F.col(text)).alias("w")).withColumn("length", F.size("w"))
    hits = lookup_filter(split.select("doc", "length", F.explode("w").alias("word")), wanted.select("word").distinct(), "word")
    return hits.repartition("doc").groupBy("doc", "word", "length").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(docs: DataFrame, wanted: DataFrame, text: str) -> tuple[DataFrame, int, float]:
    """(word, df) of the words of `wanted`, the number of documents with words, and their mean length: one scan, no text shuffled."""
    split = docs.select(words(F.col(text)).alias("w")).withColumn("length", F.size("w")).filter("length > 0")
    # Each document counts once for the empty word too, which stands for all documents.
    said = split.select("length", F.explode(F.array_append(F.array_distinct("w"), "")).alias("word"))
    keys = wanted.select("word").union(wanted.sparkSession.createDataFrame([("",)], "word string")).distinct()
    found = materialize(lookup_filter(said, keys, "word").groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.avg("length").alias("mean")), "document-frequencies")
    total = found.filter("word = ''").first()
    return found.filter("word <> ''").select("word", "df"), int(total["df"]) if total else 0, float(total["mean"]) if total else 1.0


def query_words(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """(query, word): distinct words of each query."""
    return queries.select(F.col(query_id).alias("query"), F.explode(F.array_distinct(words(F.col(text)))).alias("word"))


def bm25(postings: DataFrame, wanted: DataFrame, df: DataFrame, n_docs: int, mean_length: float, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, doc, score): BM25 of every document sharing a word with a query, from query_postings and document_frequencies.

    The queries' words go to every task if they are counted as few, so a word that all documents have burdens no task.
    """
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = wanted.join(df, "word").select("query", "word", idf.alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(mean_length)))
    if weighted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        weighted = F.broadcast(weighted)
    return postings.join(weighted, "word").groupBy("query", "doc").agg(F.sum(part).alias("score"))


def all_words_match(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query, doc, hits): documents holding every word of a query, with the number of occurrences."""
    need = wanted.groupBy("query").agg(F.count(F.lit(1)).alias("need"))
    held = postings.join(wanted, "word").groupBy("query", "doc").agg(F.count(F.lit(1)).alias("have"), F.sum("tf").alias("hits"))
    return held.join(need, "query").filter("have = need").select("query", "doc", "hits")


def nearest_vectors(vectors: DataFrame, queries: DataFrame, vec_id: str, vec: str, k: int, block: int = 4096, at_once: int = 16) -> DataFrame:
    """(query, neighbour, similarity, rank): the k nearest by cosine of each query, itself left out, exactly.

    Queries go to the workers in blocks of about `block` vectors, each multiplied as a matrix with all vectors, which are never
    shuffled; only k rows a query and task are. Results of `at_once` blocks are written before the next are sent, so
    neither driver nor workers hold more. Null vectors and vectors of another length than a query's take no part; the
    zero vector has similarity 0; ties go to the smaller id.
    """
    asked = materialize(queries.filter(F.col(vec).isNotNull() & F.col(vec_id).isNotNull()).select(F.col(vec_id).alias("query"), F.transform(vec, lambda x: x.cast("double")).alias("v")), "vector-queries")
    blocks = max(1, -(-asked.count() // block))
    held = vectors.filter(F.col(vec).isNotNull() & F.col(vec_id).isNotNull()).select(F.col(vec_id).alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("v"))
    id_type = vectors.schema[vec_id].dataType.simpleString()
    parts, done = [], []
    for at in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == at).orderBy("query").toPandas()
        for _, same in mine.groupby(mine["v"].map(len)):
            shared = vectors.sparkSession.sparkContext.broadcast((same["query"].to_numpy(), _unit_rows(np.stack(same["v"].to_numpy()))))
            parts.append(held.mapInPandas(_nearest_in(shared, k), f"query {id_type}, neighbour {id_type}, similarity double"))
        if len(parts) >= at_once and at + 1 < blocks:
            done.append(materialize(top_k(reduce(DataFrame.unionByName, parts), "query", "similarity", "neighbour", k).drop("rank"), "nearest"))
            parts = []
    every = [*done, *parts] or [held.select(F.col("id").alias("query"), F.col("id").alias("neighbour"), F.lit(0.0).alias("similarity")).limit(0)]
    return top_k(reduce(DataFrame.unionByName, every), "query", "similarity", "neighbour", k)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _nearest_in(shared: Broadcast, k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The k nearest of a task's vectors to each query, rounded to 12 places so that equal directions tie."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = shared.value
        best_id, best = np.empty((len(names), 0), names.dtype), np.empty((len(names), 0))
        for b in batches:
            b = b[b["v"].map(len) == q.shape[1]]
            if b.empty:
                continue
            ids = b["id"].to_numpy()
            score = np.round(q @ _unit_rows(np.stack(b["v"].to_numpy())).T, 12)
            score[names[:, None] == ids[None]] = -np.inf
            best = np.concatenate((best, score), 1)
            best_id = np.concatenate((best_id, np.broadcast_to(ids, score.shape)), 1)
            order = np.lexsort((best_id, -best), axis=1)[:, :k]
            best, best_id = np.take_along_axis(best, order, 1), np.take_along_axis(best_id, order, 1)
        at, nth = np.nonzero(best > -np.inf)
        yield pd.DataFrame({"query": names[at], "neighbour": best_id[at, nth], "similarity": best[at, nth]})

    return run


def reciprocal_rank_fusion(rankings: dict[str, DataFrame], k: int = 60, limit: int = 120) -> DataFrame:
    """(query, doc, score, retrievers, rank): sum of 1/(k + rank) over ranked lists (query, doc, rank), rounded to 6, best `limit` a query, ties by doc."""
    lists = [df.select("query", "doc", F.lit(name).alias("name"), (1.0 / (k + F.col("rank"))).alias("part")) for name, df in rankings.items()]
    fused = reduce(DataFrame.unionByName, lists).groupBy("query", "doc").agg(
        F.round(F.sum("part"), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("retrievers")
    )
    return top_k(fused, "query", "score", "doc", limit)


def overlap_score(query: Column, doc: Column) -> Column:
    """0.7 of the query's distinct words held plus 0.3 of the sets' Jaccard similarity, rounded to 6; 0 without words."""
    q, d = F.array_distinct(query), F.array_distinct(doc)
    both = F.size(F.array_intersect(q, d))
    jaccard = both / F.greatest(F.size(F.array_union(q, d)), F.lit(1))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.round(0.7 * both / F.size(q) + 0.3 * jaccard, 6))


def placed(df: DataFrame, pool: str, order: list[Column]) -> DataFrame:
    """`df` with, within its pool and in an order, the rows before (`n_before`, ties left out), up to it (`n_upto`, ties included) and in all (`pool_size`).

    Rows are spread by ranges of (pool, order) and written, each range is sorted by itself, and the counts of the ranges
    before are added, so that no task sorts a pool, however few pools there are.
    """
    ranged = materialize(df.repartitionByRange(F.col(pool), *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(F.col(pool).alias("__pool"), F.col("__range").alias("__at")).agg(F.count(F.lit(1)).alias("__k"))
    by_pool = Window.partitionBy("__pool")
    before = F.coalesce(F.sum("__k").over(by_pool.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumns({"__offset": before, "pool_size": F.sum("__k").over(by_pool)})
    inner = Window.partitionBy(pool, "__range").orderBy(*order)
    local = ranged.withColumns({"__rank": F.rank().over(inner), "__upto": F.count(F.lit(1)).over(inner.rangeBetween(Window.unboundedPreceding, Window.currentRow))})
    joined = local.join(F.broadcast(offsets), F.col(pool).eqNullSafe(F.col("__pool")) & (F.col("__range") == F.col("__at")))
    return joined.select(*df.columns, (F.col("__offset") + F.col("__rank") - 1).alias("n_before"), (F.col("__offset") + F.col("__upto")).alias("n_upto"), "pool_size")


def tile_of(place: Column, n: Column, tiles: int) -> Column:
    """The tile, from 1, of a place from 1 among n rows cut into `tiles` as even as can be, longer ones first."""
    size, more = F.floor(n / tiles), n % tiles
    return F.when(place <= more * (size + 1), F.ceil(place / (size + 1))).otherwise(more + F.ceil((place - more * (size + 1)) / F.greatest(size, F.lit(1)))).cast("int")


def pool_percentile(df: DataFrame, pool: str, score: str) -> DataFrame:
    """`df` with percentile (share of the pool below, in per cent, to 2 places), rank (1 + number above), pool_size and band. Null scores are below all."""
    at = placed(df, pool, [F.col(score).asc_nulls_first()])
    out = at.withColumn("percentile", F.round(100.0 * F.col("n_before") / F.col("pool_size"), 2)).withColumn("rank", F.col("pool_size") - F.col("n_upto") + 1)
    p = F.col("percentile")
    banded = out.withColumn("band", F.when(p >= 99, "top 1%").when(p >= 95, "top 5%").when(p >= 90, "top 10%").when(p >= 75, "top quarter").when(p >= 50, "top half").otherwise("lower half"))
    return banded.drop("n_before", "n_upto")


def pool_minmax(df: DataFrame, pool: str, score: str, out: str) -> DataFrame:
    """`df` with the score scaled to [0, 1] within its pool, 0.5 in a flat pool, rounded to 4."""
    w = Window.partitionBy(pool)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(out, F.when(hi == lo, 0.5).otherwise(F.round((F.col(score) - lo) / (hi - lo), 4)))


def freshness(age_days: Column, half_life: float = 7.0) -> Column:
    """Halved every `half_life` days; 1 for the future, 0.5 for null."""
    return F.when(age_days.isNull(), 0.5).when(age_days <= 0, 1.0).otherwise(F.pow(F.lit(0.5), age_days / half_life))


def weighted_total(parts: dict[str, tuple[Column, float]]) -> tuple[Column, Column]:
    """(total, assessed weight): contributions rounded to 4 and summed, at most 1; a null part adds nothing and the rest isn't scaled up."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for col, w in parts.values():
        total = total + F.coalesce(F.round(col * w, 4), F.lit(0.0))
        weight = weight + F.when(col.isNotNull(), w).otherwise(0.0)
    return F.least(F.round(total, 4), F.lit(1.0)), F.round(weight, 4)
