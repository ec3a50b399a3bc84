"""Per-key work where a few keys hold most rows.

Heavy keys are found with a mergeable frequent-items sketch (one pass, constant memory a task), their rows go
through a broadcast join that never shuffles by key, all other keys take the ordinary shuffle, and the two
branches are united. Results are exact: the sketch only decides which way a key travels.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters of the sketch. Its error is about 3.5 / TRACKED of all rows, far below any useful share.
TRACKED = 8192


def detect_heavy_keys(df: DataFrame, key: str, share: float = 0.01) -> tuple[DataFrame, int]:
    """Keys that may hold more than `share` of all rows, and the number of all rows.

    The keys come as a local DataFrame of at most a few times 1/share rows, a proven bound, so it may be broadcast.
    The sketch has no false negatives above its error, which is taken off the limit. Null is no key but its
    rows count. An empty table gives no keys and 0.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    if share * TRACKED < 16:
        raise ValueError("share is too small for the sketch")
    k = int(2 / share) + 1
    found = df.select(F.col(key).alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(k, {k}, {TRACKED})").alias("top")
    ).first()
    total = int(found["n"])
    slack = 3.5 / TRACKED * total
    heavy = [(t["item"],) for t in (found["top"] or []) if t["item"] is not None and t["count"] >= share * total - slack]
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}"
    return df.sparkSession.createDataFrame(heavy, schema), total


def split_heavy(df: DataFrame, key: str, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of heavy keys and all other rows (null keys among these). Neither side shuffles."""
    mark = F.broadcast(heavy.select(F.col(key)))
    return df.join(mark, key, "left_semi"), df.join(mark, key, "left_anti")


def skew_safe_aggregate(
    df: DataFrame, key: str, partial: Mapping[str, Column], final: Mapping[str, Column], share: float = 0.01, salts: int = 64
) -> DataFrame:
    """`groupBy(key)` in which no task gets a heavy key's rows.

    `partial` names aggregates over rows, `final` aggregates over the partial columns that give the result, so
    any pair of combinable aggregates works, also those without map-side combine. Heavy keys are aggregated
    per (key, salt) first. Null keys form no group. One row a key: key and the names of `final`.
    """
    heavy, _ = detect_heavy_keys(df, key, share)
    hot, rest = split_heavy(df.filter(F.col(key).isNotNull()), key, heavy)
    salted = hot.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    hot_parts = salted.groupBy(key, "__salt").agg(*[c.alias(n) for n, c in partial.items()]).drop("__salt")
    rest_parts = rest.groupBy(key).agg(*[c.alias(n) for n, c in partial.items()])
    outs = [c.alias(n) for n, c in final.items()]
    return hot_parts.groupBy(key).agg(*outs).unionByName(rest_parts.groupBy(key).agg(*outs))


def skew_safe_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: float = 0.01) -> DataFrame:
    """Join a skewed `left` to a `right` that has at most one row a key.

    Heavy keys of `left` meet their few right rows (bounded by the number of heavy keys) in a broadcast join;
    the others shuffle. `how` is inner or left; null keys match nothing. Columns of `right` that `left` has already are left out.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    right = right.select(key, *[c for c in right.columns if c not in left.columns])
    heavy, _ = detect_heavy_keys(left, key, share)
    hot, rest = split_heavy(left, key, heavy)
    right_hot = right.join(F.broadcast(heavy), key, "left_semi")
    return hot.join(F.broadcast(right_hot), key, how).unionByName(rest.join(right, key, how))


def keys_above_share(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys that hold more than `share` of all rows, with their exact number of rows (`n_rows`) and the total.

    The sketch proposes candidates, a broadcast join counts only their rows; nothing else is shuffled.
    """
    heavy, total = detect_heavy_keys(df, key, share)
    counted = df.select(key).join(F.broadcast(heavy), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.withColumn("n_total", F.lit(total).cast("bigint")).filter(F.col("n_rows") > F.lit(share) * F.col("n_total"))
