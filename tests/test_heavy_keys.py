from collections import Counter

from pyspark.sql import functions as F

from loomwork.operators.heavy_keys import detect_heavy_keys, keys_above_share, skew_safe_aggregate, skew_safe_join
from loomwork.operators.joins import lookup_join
from tests.conftest import rows

DATA = [("big", i) for i in range(600)] + [(f"k{i % 150}", i) for i in range(300)] + [(None, i) for i in range(100)]


def test_share_counts_null_rows_in_the_total(spark):
    df = spark.createDataFrame(DATA, "key string, v int").repartition(5)
    assert rows(keys_above_share(df, "key", 0.5)) == [("big", 600, 1000)]
    assert rows(keys_above_share(df, "key", 0.6)) == []  # exactly the share is not above it
    heavy, total = detect_heavy_keys(df, "key", 0.05)
    assert total == 1000 and [r[0] for r in heavy.collect()] == ["big"]


def test_empty_table_and_only_nulls(spark):
    empty = spark.createDataFrame([], "key string, v int")
    assert rows(keys_above_share(empty, "key", 0.05)) == []
    nulls = spark.createDataFrame([(None, 1)] * 3, "key string, v int")
    assert rows(keys_above_share(nulls, "key", 0.05)) == []
    assert rows(skew_safe_aggregate(empty, "key", {"n": F.count("v")}, {"n": F.sum("n")})) == []


def test_aggregate_equals_plain_group_by(spark):
    df = spark.createDataFrame(DATA, "key string, v int").repartition(7)
    got = skew_safe_aggregate(df, "key", {"n": F.count("v"), "m": F.max("v")}, {"n": F.sum("n"), "m": F.max("m")}, share=0.05)
    want = df.filter("key is not null").groupBy("key").agg(F.count("v"), F.max("v"))
    assert rows(got) == rows(want)


def test_join_keeps_every_row_once_and_leaves_clashing_columns_out(spark):
    left = spark.createDataFrame(DATA, "key string, v int")
    right = spark.createDataFrame([("big", 1, 9), ("k1", 2, 9)], "key string, w int, v int")
    got = skew_safe_join(left, right, "key", "left", share=0.05)
    assert got.columns == ["key", "v", "w"]
    assert Counter(r["w"] for r in got.collect()) == Counter({1: 600, 2: 2, None: 398})
    assert skew_safe_join(left, right, "key", "inner", share=0.05).count() == 602


def test_no_shuffle_of_heavy_rows_by_key(spark):
    df = spark.createDataFrame(DATA, "key string, v int")
    plan = keys_above_share(df, "key", 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_lookup_join_beyond_the_bound_gives_the_same(spark):
    left = spark.createDataFrame(DATA, "key string, v int")
    lookup = spark.createDataFrame([("big", "x"), ("big", "x"), ("k1", "y"), (None, "z")], "key string, w string")
    small, large = lookup_join(left, lookup, "key"), lookup_join(left, lookup, "key", max_rows=1)
    assert rows(small) == rows(large) and small.count() == len(DATA)
