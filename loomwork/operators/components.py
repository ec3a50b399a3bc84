"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.session import materialize


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) of every node of (src, dst) edges; a component is named by its smallest node.

    Alternating large-star and small-star rounds: every node's larger neighbours, then its smaller ones, are
    hung on the smallest node around it, until nothing changes. The rounds grow with the logarithm of the
    components' breadth, so 50 of them serve chains of any length that can be stored; each is a shuffle of the edges, written to the shared folder. Null ends and loops are
    dropped, repeated edges count once; an empty table gives none.
    """
    clean = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    current = materialize(clean.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        current = materialize(small.select("e.u", "e.v").filter("u != v").distinct(), "stars")
        state = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
