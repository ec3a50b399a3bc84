"""Selections and reports over keyed rows: backlogs, due work, joins on a prefix or on either of two keys, exact order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.joins import BROADCAST_ROWS


def prefix_join(left: DataFrame, text: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Rows of `left` with each row of `prefixes` whose `prefix` its text begins with: an equi-join on the beginnings of the lengths that occur.

    The distinct lengths, of which there are few, are read first. Null and empty prefixes match nothing.
    """
    known = prefixes.filter(F.length(prefix) > 0)
    lengths = sorted(r[0] for r in known.select(F.length(prefix)).distinct().collect())
    heads = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(text))
    spread = left.withColumn("__head", F.explode(F.transform(heads, lambda n: F.substr(F.col(text), F.lit(1), n))))
    return spread.join(known.withColumn("__head", F.col(prefix)), "__head").drop("__head")


def matching_either(left: DataFrame, first: tuple[str, DataFrame], second: tuple[str, DataFrame]) -> DataFrame:
    """Rows of `left` whose first column is among the first keys or whose second is among the second: two marks instead of a join on a disjunction."""
    out = left
    for i, (column, keys) in enumerate((first, second)):
        named = keys.toDF(column).filter(F.col(column).isNotNull()).distinct().withColumn(f"__in{i}", F.lit(True))
        out = out.join(F.broadcast(named) if named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else named, column, "left")
    return out.filter(F.col("__in0") | F.col("__in1")).select(*left.columns)


def exact_order_statistic(df: DataFrame, group: str, value: str, percent: int) -> DataFrame:
    """(group, value, n): the value at place int(n * percent / 100), at most the last, of each group's sorted values.

    Equal values are counted first, so that a group's rows are never sorted in one task, only its distinct values are.
    Null values don't count.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("__k"))
    w = Window.partitionBy(group)
    upto = counted.withColumns({"__upto": F.sum("__k").over(w.orderBy(value)), "n": F.sum("__k").over(w)})
    at = F.least(F.floor(F.col("n") * percent / 100), F.col("n") - 1)
    return upto.filter((F.col("__upto") > at) & (F.col("__upto") - F.col("__k") <= at)).select(group, value, "n")


def regression(current: Column, before: Column, tolerance: float = 2.0) -> Column:
    """first, fell or held: whether a score fell by more than `tolerance` points, of hundred, since the one before."""
    return F.when(before.isNull(), "first").when((before - current) * 100 > tolerance + 1e-9, "fell").otherwise("held")


def retry_after(attempts: Column, minutes: list[int]) -> Column:
    """Minutes until the next attempt after so many failed ones; null where no attempt is left."""
    return F.get(F.array(*map(F.lit, minutes)), attempts.cast("int") - 1)


def due_since(sources: DataFrame, last: str, now: Column, hours: int) -> DataFrame:
    """Rows last served more than `hours` before `now`, or never, with the hour bucket that names the run once."""
    late = F.col(last).isNull() | (F.col(last) < now - F.make_interval(hours=F.lit(hours)))
    return sources.filter(late).withColumn("hour_bucket", F.floor(F.unix_timestamp(now) / 3600))


def batches(df: DataFrame, order: list[Column], limit: int, size: int) -> DataFrame:
    """The first `limit` rows in an order, with their place from 1 and the batch of `size` they fall in. A top-k: each task keeps `limit` rows at most."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("batch", F.floor((F.col("place") - 1) / size))


def range_bounds(col: Column) -> Column:
    """(lower, upper) of a half-open range written as [a,b); null for anything else."""
    parts = [F.regexp_extract(col, r"^\[(-?\d+),(-?\d+)\)$", i).try_cast("bigint") for i in (1, 2)]
    return F.when(parts[0].isNotNull(), F.struct(parts[0].alias("lower"), parts[1].alias("upper")))


def add_counts(old: DataFrame, new: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Counters after an upsert that adds: one row a key with the sum of both sides."""
    return old.select(*keys, n).unionByName(new.select(*keys, n)).groupBy(*keys).agg(F.sum(n).alias(n))


def stable_groups(found: DataFrame, before: DataFrame, member: str, group: str, seen: str) -> DataFrame:
    """(member, group): each found group takes the name of the group, seen first, that any member had before, else its own.

    `before` has (member, group, seen). Ties go to the smaller name; members that were in no group before are no obstacle.
    """
    old = before.select(member, F.col(group).alias("__old"), seen)
    names = found.join(old, member).groupBy(group).agg(F.min(F.struct(seen, "__old")).alias("__first"))
    return found.join(names, group, "left").select(member, F.coalesce("__first.__old", group).alias(group))
