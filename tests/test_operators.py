import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions import extraction as ex
from loomwork.functions import postings as po
from loomwork.functions import script
from loomwork.functions.vectors import cosine, fingerprint, hamming, unit
from loomwork.operators import evaluation as ev
from loomwork.operators import matching as m
from loomwork.operators import snapshots as sn
from loomwork.operators.components import connected_components
from loomwork.operators.entities import company_key, name_similarity, ratio, resolve_names
from tests.conftest import rows


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 100)]
    got = dict(rows(connected_components(spark.createDataFrame(chain, "src int, dst int"))))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 100}
    assert rows(connected_components(spark.createDataFrame([], "src int, dst int"))) == []


def test_latest_and_merge(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y"), (None, 5, "z")], "k string, t int, v string")
    assert rows(sn.latest_per_key(df, ["k"], ["t"])) == sorted([("a", 2, None), ("b", 1, "y"), (None, 5, "z")], key=repr)
    old = spark.createDataFrame([("a", "body", 1), ("b", "keep", 2), ("c", None, 3)], "k string, body string, first int")
    new = spark.createDataFrame([("a", " ", 9), ("c", "now", 9), ("d", None, 4)], "k string, body string, first int")
    got = rows(sn.merge_snapshot(old, new, ["k"], keep_old=["first"], never_blank=["body"]))
    assert got == [("a", "body", 1, "updated"), ("b", "keep", 2, "kept"), ("c", "now", 3, "updated"), ("d", None, 4, "inserted")]
    assert rows(sn.merge_snapshot(old.limit(0), new, ["k"]))[0][-1] == "inserted"


def test_sync_health_and_streaks(spark):
    reg = spark.createDataFrame([("a", True), ("b", True), ("c", False), (None, True)], "name string, enabled boolean")
    assert rows(sn.sync_registry(reg, spark.createDataFrame([("a",), ("d",), ("d",)], "name string"), "name")) == [("a", True, "unchanged"), ("b", False, "disabled"), ("c", False, "unchanged"), ("d", True, "added")]
    counts = spark.createDataFrame([("s", i, n) for i, n in enumerate([10, 12, 10, 1, 11])], "s string, d int, n int")
    assert [r["status"] for r in sn.count_health(counts, "s", "d", "n").orderBy("d").collect()] == ["unknown"] * 3 + ["suspect", "ok"]
    e = spark.createDataFrame([("u", i, b) for i, b in enumerate([True, True, False, True])] + [("w", 0, False)], "u string, t int, bad boolean")
    assert rows(sn.longest_streak(e, "u", ["t"], F.col("bad"))) == [("u", 2, 1), ("w", 0, 0)]


def test_retrieval_against_brute_force(spark):
    texts = {1: "red fox and red dog", 2: "a red fox", 3: None, 4: "", 5: "blue dog"}
    docs = spark.createDataFrame(list(texts.items()), "id int, text string")
    queries = spark.createDataFrame([(9, "red fox"), (8, "dog"), (7, None)], "q int, text string")
    wanted = m.query_words(queries, "q", "text")
    index = m.query_postings(docs, wanted, "id", "text")
    df, n, average = m.document_frequencies(docs, wanted, "text")
    assert rows(m.all_words_match(index, wanted)) == [(8, 1, 1), (8, 5, 1), (9, 1, 3), (9, 2, 2)]
    split = {i: t.split() for i, t in texts.items() if t}
    mean = sum(map(len, split.values())) / len(split)

    def score(q, d):
        total = 0
        for w in q.split():
            df = sum(w in t for t in split.values())
            tf = split[d].count(w)
            total += math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(split[d]) / mean))
        return total

    assert (n, average) == (3, mean) and m.document_frequencies(docs.limit(0), wanted, "text")[1:] == (0, 1.0)
    got = {(q, d): s for q, d, s in rows(m.bm25(index, wanted, df, n, mean))}
    assert got.keys() == {(9, 1), (9, 2), (8, 1), (8, 5)} and all(abs(s - score({9: "red fox", 8: "dog"}[q], d)) < 1e-9 for (q, d), s in got.items())


def test_a_word_of_all_documents_meets_no_single_task(spark):
    docs = spark.range(5000, numPartitions=4).select("id", F.concat(F.lit("the the the w"), F.col("id").cast("string")).alias("text"))
    wanted = m.query_words(spark.createDataFrame([(1, "the w7"), (2, "the")], "q int, text string"), "q", "text")
    df, n, mean = m.document_frequencies(docs, wanted, "text")
    scored = m.bm25(m.query_postings(docs, wanted, "id", "text"), wanted, df, n, mean)
    sizes = [r["count"] for r in scored.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()]
    assert sum(sizes) == 10_000 and (len(sizes) == 1 or max(sizes) < 6_000)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query" not in plan and "hashpartitioning(doc" in plan


def test_places_in_few_big_pools(spark):
    r = np.random.default_rng(2)
    data = [("big" if i % 50 else None, float(r.integers(0, 40)) if i % 9 else None, i) for i in range(3000)]
    df = spark.createDataFrame(data, "p string, s double, i int")
    got = {x["i"]: x for x in m.placed(df, "p", [F.col("s").asc_nulls_first()]).collect()}
    for p in ("big", None):
        mine = [(-1.0 if s is None else s, i) for q, s, i in data if q == p]
        values = np.array([s for s, _ in mine])
        for s, i in mine[::37]:
            assert (got[i]["n_before"], got[i]["n_upto"], got[i]["pool_size"]) == ((values < s).sum(), (values <= s).sum(), len(mine))
    for n in (1, 7, 10, 23):
        tiles = [x[0] for x in spark.range(1, n + 1).select(m.tile_of(F.col("id"), F.lit(n), 10)).collect()]
        assert tiles == [j + 1 for j, part in enumerate(np.array_split(np.arange(n), 10)) for _ in part]
    assert rows(m.placed(df.limit(0), "p", [F.col("s")])) == []


def test_vectors(spark):
    vecs = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(20)] + [(90, [0.0] * 3), (91, None)], "id int, v array<double>")
    near = m.nearest_vectors(vecs, vecs.filter("id % 5 = 0"), "id", "v", 3, block=2, at_once=1)
    data = {i: np.array([i % 3, 1, i], float) for i in range(20)} | {90: np.zeros(3)}
    assert near.count() == 15
    for q, n, s, r in rows(near):
        sims = sorted(((-(data[q] @ v) / ((np.linalg.norm(data[q]) * np.linalg.norm(v)) or 1), i) for i, v in data.items() if i != q))
        assert n == sims[r - 1][1] and abs(s + sims[r - 1][0]) < 1e-9
    assert m.nearest_vectors(vecs, vecs.limit(0), "id", "v", 3).count() == 0
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    assert tuple(df.select(cosine(F.col("a"), F.col("b")), F.array_join(unit(F.col("a")).cast("array<string>"), ","), cosine(F.col("a"), F.col("a"))).first()) == (0.0, "0.6,0.8", 1.0)


def test_fusion_ties_and_percentiles(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query int, doc int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 10, 2), (1, 12, 3)], "query int, doc int, rank int")
    fused = m.reciprocal_rank_fusion({"x": a, "y": b}).orderBy("rank").collect()
    assert [(r["doc"], r["score"], r["retrievers"]) for r in fused] == [(10, 0.032522, "x,y"), (11, 0.032522, "x,y"), (12, 0.015873, "y")]
    pool = spark.createDataFrame([("p", 1.0), ("p", 2.0), ("p", 2.0), ("p", None)], "p string, s double")
    assert [(r["s"], r["percentile"], r["rank"]) for r in m.pool_percentile(pool, "p", "s").orderBy("rank", "s").collect()] == [(2.0, 50.0, 1), (2.0, 50.0, 1), (1.0, 25.0, 3), (None, 0.0, 4)]
    flat = spark.createDataFrame([("p", 3.0), ("p", 3.0)], "p string, s double")
    assert {r["x"] for r in m.pool_minmax(flat, "p", "s", "x").collect()} == {0.5}
    total = m.weighted_total({"a": (F.lit(0.5), 0.6), "b": (F.lit(None).cast("double"), 0.4)})
    assert tuple(spark.range(1).select(*total).first()) == (0.3, 0.6)
    assert [round(spark.range(1).select(m.freshness(F.lit(d).cast("double"))).first()[0], 4) for d in (None, -1, 7, 14)] == [0.5, 1.0, 0.5, 0.25]


def test_metrics_and_agreement(spark):
    r = spark.createDataFrame([("q", 1, 3), ("q", 2, 0), ("q", 3, 2), ("z", 1, None)], "query string, rank int, grade int")
    got = {x["query"]: x for x in ev.ranking_metrics(r).collect()}
    assert got["q"]["ndcg"] == round((7 + 3 / 2) / (7 + 3 / math.log2(3)), 4) and got["q"]["mrr"] == 1.0
    assert (got["z"]["ndcg"], got["z"]["mrr"], got["z"]["recall_grade3"]) == (0.0, 0.0, 1.0)
    pairs = spark.createDataFrame([("g", x, y) for x, y in [(1, 1), (1, 1), (0, 0), (0, 1), (1, None)]] + [("h", 1, 1)], "g string, a int, b int")
    assert dict((x[0], x[2]) for x in rows(ev.cohens_kappa(pairs, "g"))) == {"g": 0.5, "h": 1.0}
    ratings = spark.createDataFrame([("g", i, x) for i, xs in enumerate([[1, 1, 1], [0, 0, 0], [1, 0, 1], [1, 1]]) for x in xs], "g string, i int, l int")
    assert rows(ev.fleiss_kappa(ratings, "g", "i", "l")) == [("g", 3, 0.55)]
    assert rows(ev.consensus(spark.createDataFrame([("d", g) for g in (0, 3, 2, 1)], "d string, g int"), ["d"], "g")) == [("d", 1, 4)]
    peaks = spark.createDataFrame([([1, 2, 3, 2],), ([1, 2, 1, 2],), ([1],), ([2, 2, 1],)], "v array<int>")
    assert [x[0] for x in peaks.select(ev.peak_is_single(F.col("v"))).collect()] == [True, False, True, True]


def test_preferences_stay_within_bounds(spark):
    r = np.random.default_rng(1)
    x = r.random((80, 2))
    data = [("u", float(a), float(b), float(a > 0.5)) for a, b in x] + [("few", 1.0, None, 1.0), ("none", 1.0, 1.0, None)]
    df = spark.createDataFrame(data, "u string, a double, b double, y double")
    got = {k: (p, n, w) for k, p, n, w in rows(ev.fit_preferences(df, "u", ["a", "b"], "y", [0.6, 0.4]))}
    w = got["u"][2]
    assert abs(sum(w) - 1) < 1e-6 and 0.6 < w[0] <= 0.84 and w[1] >= 0.24
    assert got["few"] == (1, 0, [0.6, 0.4]) and "none" not in got


def test_names(spark):
    given = ["Acme, Inc.", "A.B.C. GmbH & Co. KG", "Ltd", None, "شركة النور", "النور القابضة", "أحمد + Söhne ltd co"]
    names = spark.createDataFrame([(x,) for x in given], "name string").select(company_key("name"))
    assert [r[0] for r in names.collect()] == ["acme", "abc gmbh and", "ltd", "", "النور", "النور", "احمد + söhne"]
    assert ratio("", "") == 1 and ratio("ab", "ba") == 0.5 and name_similarity("north star", "star north") == 1
    known = spark.createDataFrame([(1, "Acme Inc"), (2, "Northern Light Systems"), (3, None)], "company_id int, name string")
    refs = spark.createDataFrame([("ACME",), ("Northern Ligth Systems",), ("Northern Light",), ("Other",), (" ",), (None,)], "name string")
    got = {r["name"]: (r["company_id"], r["method"]) for r in resolve_names(refs, known).collect()}
    assert got == {"ACME": (1, "alias"), "Northern Ligth Systems": (2, "fuzzy"), "Northern Light": (2, "review"), "Other": (None, "new")}


@pytest.mark.parametrize(("raw", "want"), [("Senior C++ Engineer (m/w/d) - Remote", "senior c++ engineer"), ("Data_Analyst #12345", "data analyst"), (None, ""), ("مهندسة برمجيّات", "مهندسه برمجيات")])
def test_titles(spark, raw, want):
    assert one(spark, raw, po.normalize_title) == want


def test_posting_fields(spark):
    assert [one(spark, t, po.seniority) for t in ("Senior Staff Engineer", "Engineer II", "Working Student", "Chef", None)] == ["staff", "junior", "intern", None, None]
    assert [one(spark, t, po.workplace) for t in ("hybrid remote", "Remote", "in-office", "x")] == ["hybrid", "remote", "onsite", None]
    assert [one(spark, t, po.employment) for t in ("Full_time", "freelance", "odd", "", None)] == ["full_time", "contract", "other", None, None]
    urls = {"HTTPS://www.Ex.com:443/a/?utm_source=x&b=2&a=1#top": "https://ex.com/a?a=1&b=2", "http://ex.com:8080/p?gh_jid=5&ref=q": "http://ex.com:8080/p?gh_jid=5", "no url": "no url"}
    assert [one(spark, u, po.canonical_url) for u in urls] == list(urls.values())
    assert [one(spark, u, po.registrable_domain) for u in ("https://a.b.co.uk/x", "http://jobs.lever.co", "http://localhost", None)] == ["b.co.uk", "lever.co", None, None]
    assert one(spark, "https://jobs.lever.co/x", po.is_shared_host) and not one(spark, None, po.is_shared_host)
    assert po.plain_text("<p>A &amp; B</p><ul><li>x</li></ul><script>bad</script>") == "A & B\n• x"
    assert po.plain_text("&lt;p&gt;A &amp;amp; B&lt;/p&gt;") == "A & B" and po.plain_text(None) == ""


def test_script(spark):
    assert one(spark, "خبرة وPython", script.segment_scripts) == "خبرة و Python"
    assert one(spark, "أحمـَد‏ ٣،", script.fold_arabic) == "احمد 3,"
    assert [one(spark, t, script.script_language) for t in ("abc عربي", "abc", "", None)] == ["ar", "en", "en", None]
    assert one(spark, "abc عربي", script.is_mixed_script) and not one(spark, "", script.is_mixed_script)


def test_fingerprints(spark):
    a = "the quick brown fox jumps over the lazy dog " * 30
    assert fingerprint(None) == fingerprint("") == 0 and fingerprint(a) == fingerprint(a.upper())
    near = fingerprint(a + " again")
    df = spark.createDataFrame([(fingerprint(a), near, -1)], "a bigint, b bigint, c bigint")
    assert df.select(hamming(F.col("a"), F.col("b"))).first()[0] <= 8 and df.select(hamming(F.col("c"), F.lit(0).cast("bigint"))).first()[0] == 64


def test_extraction(spark):
    cv = "Experience:\n• Built a pipeline for many users\n  and kept it running\n- short\nSkills\n* Python and SQL for data engineering."
    assert [(b[0].split("\n")[0], b[3]) for b in ex.bullets_of(cv)] == [("Built a pipeline for many users", "experience"), ("Python and SQL for data engineering.", "skills")]
    assert all(cv[b[1] : b[2]].strip() == b[0] for b in ex.bullets_of(cv))
    job = "About\nWe make things of all sorts\nRequirements\n- At least 5 years of Python\n- Knowledge of Arabic would be great\nNice to have\n- Kotlin in larger projects"
    assert [(r[1], r[2]) for r in ex.requirements_of(job)] == [("experience", True), ("skill", False), ("skill", False)]
    assert ex.years_stated("3+ years, 30 years or 5-7 yrs") == 3.0 and ex.years_stated(None) is None
    text, counts = ex.redacted("Mail a@b.com or a@b.com, call +20 100 123 4567; 4000000 events")
    assert text == "Mail [[EMAIL_1]] or [[EMAIL_1]], call [[PHONE_1]]; 4000000 events" and counts == {"EMAIL": 1, "PHONE": 1}
    assert ex.span_of("A  big\nfox", "a BIG fox") == (0, 10, "relocated") and ex.span_of("x", "y") is None and ex.span_of("abc", "bc") == (1, 3, "exact")
    df = spark.createDataFrame([(cv,), (None,), ("",)], "t string")
    assert [len(r[0]) for r in df.select(ex.bullets("t")).collect()] == [2, 0, 0]
    assert df.select(ex.requirements("t"), ex.min_years("t"), ex.redact("t"), ex.find_span("t", F.lit("pipeline"))).count() == 3


def test_extraction_of_long_texts_is_whole(spark):
    job = "Requirements\n" + "\n".join(f"- At least {i} years of plumbing" for i in range(1, 46))
    assert len(ex.requirements_of(job)) == 45
    (body, start, end, _), = ex.bullets_of("- " + "kept the line running " * 50)
    assert len(body) == end - start > 1000
    docs = spark.createDataFrame([(job,)], "t string")
    assert docs.select(F.size(ex.requirements("t"))).first()[0] == 45


def test_misspelt_names_without_a_common_word(spark):
    known = spark.createDataFrame([(1, "Bogosekuoptics Inc"), (2, "Northern Light Systems"), (3, "Vabolise")], "company_id int, name string")
    refs = spark.createDataFrame([("Bogosekuoptisc",), ("Nothern Ligth Sytems",), ("Quite Other",)], "name string")
    got = {r["name"]: (r["company_id"], r["method"]) for r in resolve_names(refs, known).collect()}
    assert got == {"Bogosekuoptisc": (1, "fuzzy"), "Nothern Ligth Sytems": (2, "fuzzy"), "Quite Other": (None, "new")}
