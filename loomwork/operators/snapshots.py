"""Keyed snapshots: latest rows, merges without a table format, sync, health of feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the one with the greatest `order` columns. An aggregate, so heavy keys are combined before the shuffle; null keys form a group."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c).alias(c) for c in rest]), F.struct(*order)).alias("__r"))
    return best.select(*keys, *[F.col("__r")[c].alias(c) for c in rest]).select(*df.columns)


def merge_snapshot(old: DataFrame, new: DataFrame, keys: list[str], keep_old: list[str] = (), never_blank: list[str] = ()) -> DataFrame:
    """The snapshot after an upsert, with `op` (inserted, updated or kept).

    New values win, but columns of `keep_old` keep the first non-null value and those of `never_blank` aren't
    overwritten by null or blank. `new` must have one row a key (see latest_per_key); null keys match nothing and are kept as they are.
    """
    o, n = old.alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    old_there = F.col("o.__old").isNotNull()
    o = old.withColumn("__old", F.lit(True)).alias("o")
    joined = o.join(n, on, "full_outer")

    def value(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keys:
            return F.coalesce(a, b)
        if c in keep_old:
            return F.coalesce(a, b)
        if c in never_blank:
            return F.when(F.trim(F.coalesce(b, F.lit(""))) != "", b).otherwise(F.coalesce(a, b))
        return F.when(F.col("n.__new").isNotNull(), b).otherwise(a)

    op = F.when(~old_there, "inserted").when(F.col("n.__new").isNotNull(), "updated").otherwise("kept")
    return joined.select(*[value(c).alias(c) for c in old.columns], op.alias("op"))


def sync_registry(registry: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, enabled, op): keys of both sides; those not wanted are disabled, unknown ones added enabled. Null keys are left out."""
    a = registry.filter(F.col(key).isNotNull()).select(key, "enabled").dropDuplicates([key]).withColumn("__a", F.lit(True))
    b = wanted.filter(F.col(key).isNotNull()).select(key).distinct().withColumn("__b", F.lit(True))
    both = a.join(b, key, "full_outer")
    there, wish = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    op = F.when(~there, "added").when(~wish & F.col("enabled"), "disabled").otherwise("unchanged")
    return both.select(key, F.when(wish, F.coalesce("enabled", F.lit(True))).otherwise(F.lit(False)).alias("enabled"), op.alias("op"))


def count_health(counts: DataFrame, source: str, period: str, n: str, back: int = 7, ratio: float = 0.20, least: int = 3) -> DataFrame:
    """Each period's count against the median of the source's `back` periods before: median_before and status ok, suspect or unknown."""
    w = Window.partitionBy(source).orderBy(period).rowsBetween(-back, -1)
    before = F.collect_list(n).over(w)
    sorted_before, size = F.array_sort(before), F.size(before)
    median = (F.get(sorted_before, F.floor((size - 1) / 2).cast("int")) + F.get(sorted_before, F.floor(size / 2).cast("int"))) / 2.0
    status = F.when(size < least, "unknown").when(F.col(n) < ratio * median, "suspect").otherwise("ok")
    return counts.select(source, period, n, F.when(size >= least, median).alias("median_before"), status.alias("status"))


def longest_streak(events: DataFrame, key: str, order: list[str], bad: Column) -> DataFrame:
    """(key, longest, current): the longest run of rows in which `bad` holds, and the one that lasts to the end."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = events.select(key, bad.cast("int").alias("b"), F.row_number().over(w).alias("n"), F.sum((~bad).cast("int")).over(w).alias("run"))
    runs = marked.groupBy(key, "run").agg(F.sum("b").alias("len"))
    return runs.groupBy(key).agg(F.max("len").alias("longest"), F.max_by("len", "run").alias("current"))


def ambiguous_values(df: DataFrame, value: str, most: int = 8) -> DataFrame:
    """(value, n): values that more than `most` rows share, and that therefore identify nothing."""
    return df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
