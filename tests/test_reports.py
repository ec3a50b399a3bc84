import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomwork.functions import extraction as ex
from loomwork.functions import pages
from loomwork.functions import postings as po
from loomwork.functions.vectors import parse_vector, vector_literal
from loomwork.operators import evaluation as ev
from loomwork.operators import reports as rp
from tests.conftest import rows


def one(spark, col):
    return spark.range(1).select(col).first()[0]


@pytest.mark.parametrize(
    ("code", "page", "title", "company", "same", "want"),
    [
        (404, "x", "t", None, True, "gone"), (403, "x", "t", None, True, "blocked"), (500, "x", "t", None, True, "unknown"),
        (200, "<p>Sorry, this position has been FILLED</p>", "Nurse", None, True, "gone"),
        (200, "<h1>Senior nurse</h1><script>Analyst</script>", "Analyst", "Acme Clinics", True, "redirected"),
        (200, "<h1>Senior nurse</h1>", "Sr. NURSE (m/f)", "Acme Clinics", True, "live"), (200, "at acme clinics", "Cook", "Acme", False, "redirected"),
        (200, None, "Cook", "Acme", True, "live"),
    ],
)
def test_pages(spark, code, page, title, company, same, want):
    text = lambda v: F.lit(v).cast("string")
    if page is None:
        want = "redirected"
    assert one(spark, pages.page_state(F.lit(code), F.coalesce(text(page), F.lit("")), text(title), text(company), F.lit(same))) == want


def test_phrases_and_stance(spark):
    assert one(spark, pages.phrases_in(F.lit("Guaranteed! 90% CHANCE"), pages.FORBIDDEN_PHRASES)) == ["guaranteed", "% chance"]
    assert one(spark, pages.phrases_in(F.lit(None).cast("string"), pages.FORBIDDEN_PHRASES)) == []
    assert [one(spark, ex.sponsorship(F.lit(t).cast("string"))) for t in ("We sponsor.", "No visa sponsorship, though we sponsor", "hello", None)] == [True, False, None, None]


def test_vectors_as_text(spark):
    assert one(spark, vector_literal(F.array(F.lit(1.5), F.lit(-2.0)))) == "[1.500000,-2.000000]"
    assert [one(spark, parse_vector(F.lit(t).cast("string"))) for t in ("[1, 2.5]", " 3 ", "[]", None, "[a]")] == [[1.0, 2.5], [3.0], [], None, None]


def test_links(spark):
    url = "https://x.example/A?utm_source=a&Ref=b#top"
    assert one(spark, po.without_parameters(F.lit(url), po.ANALYTICS)) == "https://x.example/A?Ref=b#top"
    assert one(spark, po.without_parameters(F.lit("https://x.example/?fbclid=1"), po.ANALYTICS)) == "https://x.example/"
    assert one(spark, po.company_domain(F.lit(None).cast("string"), F.lit("https://jobs.lever.co/a"), F.lit("https://www.acme.co.uk/jobs"))) == "acme.co.uk"
    assert one(spark, po.company_domain(F.lit("https://jobs.lever.co/a"))) is None


def test_joins_on_prefixes_and_either_key(spark):
    left = spark.createDataFrame([(1, "abc"), (2, "ab"), (3, None), (4, "x")], "i int, t string")
    heads = spark.createDataFrame([("ab", 1), ("abc", 2), ("", 3), (None, 4)], "p string, k int")
    assert [(r["i"], r["k"]) for r in sorted(rp.prefix_join(left, "t", heads, "p").collect())] == [(1, 1), (1, 2), (2, 1)]
    assert rows(rp.prefix_join(left, "t", heads.limit(0), "p")) == []
    df = spark.createDataFrame([(1, 5), (2, 6), (None, 7), (3, None), (1, 6)], "a int, b int")
    keys = lambda *v: spark.createDataFrame([(x,) for x in v], "k int")
    assert rows(rp.matching_either(df, ("a", keys(1, None, 1)), ("b", keys(6, 7)))) == sorted([(1, 5), (2, 6), (None, 7), (1, 6)], key=repr)


def test_order_statistics(spark):
    for n in (1, 19, 20, 21, 100):
        df = spark.createDataFrame([("g", float(v // 3)) for v in range(n)] + [("none", None)], "g string, v double")
        want = sorted(v // 3 for v in range(n))[min(n * 95 // 100, n - 1)]
        assert rows(rp.exact_order_statistic(df, "g", "v", 95)) == [("g", float(want), n)]


def test_regressions_retries_and_ranges(spark):
    d = lambda v: F.lit(v).cast("double")
    assert [one(spark, rp.regression(d(a), d(b))) for a, b in ((0.5, None), (0.73, 0.75), (0.72, 0.75), (0.8, 0.7))] == ["first", "held", "fell", "held"]
    assert [one(spark, rp.retry_after(F.lit(n), [1, 5, 25])) for n in (1, 3, 4)] == [1, 25, None]
    assert one(spark, rp.range_bounds(F.lit("[-2,7)"))) == (-2, 7) and one(spark, rp.range_bounds(F.lit("(1,2]"))) is None


def test_due_and_batches(spark):
    now = dt.datetime(2024, 1, 2)
    df = spark.createDataFrame([(1, None), (2, dt.datetime(2024, 1, 1, 23)), (3, dt.datetime(2023, 1, 1))], "i int, last timestamp_ntz")
    assert [r["i"] for r in rp.due_since(df, "last", F.lit(now).cast("timestamp_ntz"), 24).collect()] == [1, 3]
    got = rp.batches(spark.range(60), [F.col("id").desc()], 7, 3)
    assert rows(got.select("place", "batch", "id")) == [(i, (i - 1) // 3, 60 - i) for i in range(1, 8)]


def test_groups_keep_their_names(spark):
    found = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "m int, g int")
    before = spark.createDataFrame([(2, 90, 5), (1, 80, 6), (4, 70, 1), (9, 60, 0)], "m int, g int, seen int")
    assert rows(rp.stable_groups(found, before, "m", "g", "seen")) == [(1, 90), (2, 90), (3, 3), (4, 70)]
    assert rows(rp.add_counts(found.toDF("k", "n"), found.limit(1).toDF("k", "n"), ["k"], "n")) == [(1, 2), (2, 1), (3, 3), (4, 4)]


def test_controls(spark):
    df = spark.createDataFrame([("g", True, 0.5), ("g", False, 0.3), ("h", True, 0.9)], "g string, own boolean, s double")
    assert rows(ev.separation(df, "g", F.col("own"), "s", 0.15)) == [("g", 0.5, 0.3, True), ("h", 0.9, None, None)]
    pairs = spark.createDataFrame([("g", i, i * 10) for i in range(5)] + [("one", 9, 90)], "g string, l int, r int")
    out = ev.derangement(pairs, "g", "l", "r").collect()
    assert all(x["other"] != x["r"] for x in out if x["g"] == "g") and sorted(x["other"] for x in out if x["g"] == "g") == [0, 10, 20, 30, 40]
    none = ev.macro_average(spark.createDataFrame([], "query string, ndcg double"), ["ndcg"])
    assert rows(none) == [(0.0, 0)]
