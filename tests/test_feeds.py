import json
from collections import defaultdict

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomwork.sources import feeds
from loomwork.streaming.ingest import drain, windowed_counts
from tests.conftest import rows

SF = "/root/testdata/sf0.001"


def test_every_query_runs_and_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["ingest_id", "utc_us"] and df.count() > 0


def test_posting_schema(spark):
    df = feeds.normalized_postings(spark, SF)
    assert df.columns == feeds.POSTING
    assert df.groupBy("source").count().count() == 5
    with pytest.raises(ValueError):
        feeds.normalized_postings(spark, SF, ["nowhere"])


def test_language_of_the_whole_body(spark):
    schema = "ingest_id long, id string, title string, location string, isRemote boolean, employmentType string, publishedAt string, jobUrl string, applyUrl string, descriptionPlain string"
    late = "We offer free lunch. " * 250 + "نبحث عن مهندس بيانات خبير " * 250
    df = spark.createDataFrame([(1, "a", "Engineer", None, None, None, None, None, None, late), (2, "b", "Engineer", None, None, None, None, None, None, late[:5000])], schema)
    assert [r["language"] for r in feeds.ashby(df).orderBy("ingest_id").collect()] == ["ar", "en"]


def test_pay_range(spark):
    schema = "ingest_id int, compensation struct<compensationTiers:array<struct<components:array<struct<compensationType:string,minValue:double,maxValue:double,currencyCode:string>>>>>"
    data = [(1, ([([("Equity", 1.0, None, "x")],), (None,), ([("Salary", None, 9.0, "eur")],)],)), (2, None), (3, ([],))]
    assert rows(feeds.pay_range(spark.createDataFrame(data, schema))) == [(1, None, 9.0, "EUR")]


def test_sinks(spark, tmp_path):
    payloads = spark.createDataFrame([(1, "x", dt.datetime(2026, 1, 5)), (2, "y", dt.datetime(2026, 2, 5))], "payload_id int, payload string, fetched_at timestamp")
    feeds.append_payloads(payloads, str(tmp_path / "raw"))
    feeds.append_payloads(payloads, str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "raw")).filter("fetch_month = '2026-01'").count() == 2
    feeds.write_labels(spark.createDataFrame([("q", "d", 3), ("q", "e", None)], "query string, doc string, grade int"), str(tmp_path / "labels"))
    assert rows(feeds.read_labels(spark, str(tmp_path / "labels"))) == [("q", "d", 3)]
    feeds.write_labels(spark.createDataFrame([("q", "d", 7)], "query string, doc string, grade int"), str(tmp_path / "bad"))
    with pytest.raises(Exception, match="bad grade"):
        feeds.read_labels(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "one.json").write_text("[1,\n2]")
    assert feeds.read_payloads(spark, str(tmp_path / "one.json")).first()["payload"] == "[1,\n2]"


def test_stream_reads_only_new_files_and_keeps_the_latest(spark, tmp_path):
    def put(data, mode="append"):
        spark.createDataFrame(data, "k string, t int, v string").coalesce(1).write.mode(mode).parquet(str(tmp_path / "in"))

    put([("a", 1, "x"), ("b", 1, "y"), (None, 1, "n")])
    state = str(tmp_path / "state")
    assert len(rows(drain(spark, str(tmp_path / "in"), ["k"], ["t"], state))) == 3
    put([("a", 2, "z"), ("b", 0, "late")])
    assert rows(drain(spark, str(tmp_path / "in"), ["k"], ["t"], state).filter("k is not null")) == [("a", 2, "z"), ("b", 1, "y")]


def test_stream_windows_agree_with_batch(spark):
    got = windowed_counts(spark, f"{SF}/events.parquet*", "ts", "event_type")
    batch = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.to_date("ts").alias("d"), "event_type").count()
    assert got.agg(F.sum("n")).first()[0] == batch.agg(F.sum("count")).first()[0] and got.count() == batch.count()


def test_payloads_become_postings(spark):
    """Against a plain reader, over the payloads that are plain JSON."""
    t = spark.read.parquet("/root/testdata/sf0.01/raw_payloads.parquet")
    got = defaultdict(list)
    for r in feeds.payload_postings(t).collect():
        got[r["ingest_id"]].append((r["source"], r["pos"], r["external_id"], r["title"]))
    seen = 0
    for r in t.collect():
        try:
            answer = json.loads(r["payload"].removeprefix("\ufeff"))
        except (ValueError, AttributeError):
            assert r["payload_id"] not in got
            continue
        jobs = answer.get("jobs") if isinstance(answer, dict) else answer if r["adapter"] == "lever" else None
        if not isinstance(jobs, list):
            continue
        names = {"lever": ("id", "text"), "workable": ("shortcode", "title")}.get(r["adapter"], ("id", "title"))
        text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
        want = [(r["adapter"], i, text(j.get(names[0])), text(j.get(names[1]))) for i, j in enumerate(jobs) if isinstance(j, dict)]
        assert set(got[r["payload_id"]]) == set(want)
        seen += len(want)
    assert seen > 500
    offers = [(1, "recruitee", json.dumps({"offers": [{"id": 5, "title": "Cook", "description": "<p>Hi</p>", "city": "X", "country_code": "DE"}]})), (2, "smartrecruiters", json.dumps({"content": [{"id": "s", "name": "Nurse"}]})), (3, "other", "[]"), (4, None, None)]
    rows = feeds.payload_postings(spark.createDataFrame(offers, "payload_id bigint, adapter string, payload string")).collect()
    assert sorted((r["source"], r["external_id"], r["title"], r["location"], r["description"]) for r in rows) == [("recruitee", "5", "Cook", "X, DE", "Hi"), ("smartrecruiters", "s", "Nurse", None, "")]
