"""Joins that check a size before they broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a narrow lookup is sent to every task.
BROADCAST_ROWS = 200_000


def lookup_join(left: DataFrame, lookup: DataFrame, key: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join to a lookup table with one row a key.

    The lookup's rows are counted first (the count stops at the bound): within it the join is a broadcast and
    `left` isn't shuffled, so skewed keys don't matter; beyond it the join shuffles and AQE splits skewed keys.
    Null keys match nothing. Repeated keys in the lookup keep one row, so no left row is multiplied; columns of
    the lookup that `left` has already are left out.
    """
    lookup = lookup.select(key, *[c for c in lookup.columns if c not in left.columns]).dropDuplicates([key])
    if lookup.limit(max_rows + 1).count() <= max_rows:
        lookup = F.broadcast(lookup)
    return left.join(lookup, key, "left")


def lookup_filter(left: DataFrame, keys: DataFrame, key: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of `left` whose key is among `keys`, counted first as in lookup_join. Null keys match nothing; repeated keys multiply nothing."""
    keys = keys.select(key)
    if keys.limit(max_rows + 1).count() <= max_rows:
        keys = F.broadcast(keys)
    return left.join(keys, key, "left_semi")
