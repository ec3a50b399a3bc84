import random

import pandas as pd
from pyspark.sql import functions as F

from loomwork.operators.clusters import cluster_members, cluster_postings
from loomwork.queries import snapshots
from loomwork.session import table

SF = "/root/testdata/sf0.001"
SCHEMA = "ingest_id long, source string, external_id string, url_key string, company string, title string, head string, location string, len int, print long, native boolean, posted_us long"


def row(i, source="a", company="acme", title="data engineer", location="", length=900, fingerprint=0, key=None, url=None, native=False):
    return (i, source, key or f"k{i}", url, company, title, " ".join(title.split()[:3]), location, length, fingerprint, native, i)


def test_every_stage(spark):
    data = [
        row(1, key="x"), row(2, key="x", title="other"),  # delivered again
        row(3, source="b", url="u", company="b"), row(4, source="c", url="u", company="c"),  # one address
        *[row(i, source=f"s{i}", url="board", company=f"c{i}") for i in range(10, 19)],  # an address of nine identifies nothing
        row(20, "p", "short", length=10, location="cairo"), row(21, "q", "short", fingerprint=-1), row(22, "r", "short", length=5, location="giza"),  # whole titles
        row(23, "r", "elsewhere", length=5), row(24, "q", "short", title="data analyst", length=5),
        row(30, "p", "long"), row(31, "q", "long", fingerprint=7, length=2000, native=True), row(32, "q", "long", fingerprint=3), row(33, "r", "long", fingerprint=-1), row(34, "q", "else", fingerprint=7),
    ]
    got = {r["ingest_id"]: r for r in cluster_postings(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got.keys() == {d[0] for d in data}
    sets = {frozenset(i for i, r in got.items() if r["cluster"] == c) for c in {r["cluster"] for r in got.values()}}
    assert {s for s in sets if len(s) > 1} == {frozenset(s) for s in ((1, 2), (3, 4), (20, 21), (30, 31, 32))}
    assert [got[i]["reason"] for i in (2, 4, 21, 31, 22)] == ["exact_key", "canonical_url", "title_exact", "simhash", "singleton"]
    assert got[30]["canonical_id"] == 31 and got[32]["n_members"] == 3 and got[21]["canonical_id"] == 21


def plain(rows):
    """The rules one pair at a time."""
    parent, size, place = {r[0]: r[0] for r in rows}, {r[0]: 1 for r in rows}, {r[0]: r[7] for r in rows}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    def merge(a, b):
        p, q = find(a), find(b)
        if p == q:
            return
        if size[p] < size[q]:
            p, q = q, p
        parent[q], size[p] = p, size[p] + size[q]
        place[find(a)] = place[a] or place[b]

    for key in (lambda r: (r[1], r[2]), lambda r: r[3]):
        same = {}
        for r in rows:
            if key(r) is not None:
                same.setdefault(key(r), []).append(r[0])
        for ids in same.values():
            for other in ids[1:]:
                merge(ids[0], other)
    blocks = {}
    for r in rows:
        blocks.setdefault((r[4], r[6]), []).append(r)
    for block in blocks.values():
        for i, a in enumerate(block):
            for b in block[i + 1 :]:
                p, q = place[find(a[0])], place[find(b[0])]
                if find(a[0]) == find(b[0]) or a[1] == b[1] or (p and q and p != q):
                    continue
                if a[5] == b[5] if min(a[8], b[8]) < 400 else (a[9] ^ b[9]).bit_count() <= 3:
                    merge(a[0], b[0])
    groups = {}
    for r in rows:
        groups.setdefault(find(r[0]), set()).add(r[0])
    return {frozenset(g) for g in groups.values()}


def test_members_as_pair_by_pair():
    r = random.Random(1)
    for _ in range(60):
        rows = [
            row(i, r.choice("abc"), r.choice("xy"), r.choice(["cook", "cook one", "head of the kitchen one", "head of the kitchen two"]), r.choice(["", "", "p", "q"]), r.choice([10, 900]), r.choice([0, 1, 15, 31]), f"k{r.randrange(25)}", r.choice([None, None, None, "u", "v"]))
            for i in range(30)
        ]
        df = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).rename(columns={"url_key": "url_group"})
        got = cluster_members(df.sample(frac=1, random_state=1))
        assert {frozenset(g) for g in got.groupby("cluster")["ingest_id"].apply(list)} == plain(rows)


def test_no_posting_is_lost(spark):
    got = snapshots.posting_clusters(spark, SF)
    ids = table(spark, SF, "lever_postings").select("ingest_id").unionByName(table(spark, SF, "ashby_jobs").select("ingest_id"))
    assert got.count() == ids.count() and ids.join(got, "ingest_id", "left_anti").count() == 0
    again = table(spark, SF, "lever_postings").join(got, "ingest_id").groupBy("board", "id").agg(F.count_distinct("cluster").alias("n"))
    assert again.filter("n > 1").count() == 0
