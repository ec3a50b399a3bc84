"""Ranking quality, agreement of raters, sampling for labels, and preference fitting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.operators.matching import placed, tile_of


def ranking_metrics(ranked: DataFrame, k: int = 10) -> DataFrame:
    """Per query of (query, rank, grade): ndcg at k, reciprocal rank of the first grade >= 2, precision at 5 and recall of grade 3 at 10.

    Gains are 2**grade - 1, the ideal order is over all labels of the query; null grades count as 0. Without
    any gain ndcg is 0; without a grade of 3 its recall is 1. Rounded to 4.
    """
    grade = F.coalesce(F.col("grade"), F.lit(0))
    ideal = F.row_number().over(Window.partitionBy("query").orderBy(grade.desc(), F.col("rank")))
    r = ranked.select("query", "rank", grade.alias("g"), ideal.alias("best"))
    gain = lambda at: F.sum(F.when(F.col(at) <= k, (F.pow(F.lit(2.0), "g") - 1) / F.log2(F.col(at) + 1.0)).otherwise(0.0))
    agg = r.groupBy("query").agg(
        gain("rank").alias("dcg"), gain("best").alias("ideal"), F.min(F.when(F.col("g") >= 2, F.col("rank"))).alias("first"),
        F.avg(F.when(F.col("rank") <= 5, (F.col("g") >= 2).cast("double"))).alias("p5"),
        F.sum((F.col("g") >= 3).cast("int")).alias("targets"), F.sum(((F.col("g") >= 3) & (F.col("rank") <= 10)).cast("int")).alias("hits"),
    )
    return agg.select(
        "query",
        F.round(F.when(F.col("ideal") == 0, 0.0).otherwise(F.col("dcg") / F.col("ideal")), 4).alias("ndcg"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 4).alias("mrr"),
        F.round(F.coalesce("p5", F.lit(0.0)), 4).alias("p_at_5"),
        F.round(F.when(F.col("targets") == 0, 1.0).otherwise(F.col("hits") / F.col("targets")), 4).alias("recall_grade3"),
    )


def macro_average(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row: the mean of each metric over the queries, each query counting once, rounded to 4, and their number; 0 without queries."""
    return metrics.agg(*[F.round(F.coalesce(F.avg(n), F.lit(0.0)), 4).alias(n) for n in names], F.count(F.lit(1)).alias("queries"))


def metrics_by_cell(ranked: DataFrame, cell: list[str], least: int = 20) -> DataFrame:
    """Per cell of (query, rank, grade, *cell): queries, pairs, and the mean ndcg of rankings of the cell's rows alone; null under `least` pairs."""
    place = F.row_number().over(Window.partitionBy("query", *cell).orderBy("rank"))
    names = [*cell, "query"]
    alone = ranked.withColumn("rank", place).withColumn("__q", F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in names]))
    scored = ranking_metrics(alone.select(F.col("__q").alias("query"), "rank", "grade")).select(F.col("query").alias("__q"), "ndcg")
    sizes = alone.groupBy("__q", *cell).agg(F.count(F.lit(1)).alias("pairs"))
    both = sizes.join(scored, "__q").groupBy(*cell).agg(F.count(F.lit(1)).alias("queries"), F.sum("pairs").alias("pairs"), F.avg("ndcg").alias("ndcg"))
    return both.select(*cell, "queries", "pairs", F.when(F.col("pairs") >= least, F.round("ndcg", 4)).alias("ndcg"))


def separation(scored: DataFrame, group: str, inside: Column, score: str, least: float) -> DataFrame:
    """(group, mean_in, mean_out, passed): whether a score tells what belongs from what doesn't by at least `least`; null without both kinds."""
    means = scored.groupBy(group).agg(F.avg(F.when(inside, F.col(score))).alias("i"), F.avg(F.when(~inside, F.col(score))).alias("o"))
    return means.select(group, F.round("i", 4).alias("mean_in"), F.round("o", 4).alias("mean_out"), (F.round(F.col("i") - F.col("o"), 6) >= least).alias("passed"))


def derangement(pairs: DataFrame, group: str, left: str, right: str) -> DataFrame:
    """`pairs` with `other`: the right side of the next pair of the group in the order of a hash of `left`, the first one's for the last; no pair keeps its own unless it is alone.

    A fixed reassignment that repeats whenever it is run. A group is sorted in one task, so groups are samples to be judged.
    """
    w = Window.partitionBy(group).orderBy(F.md5(F.col(left).cast("string")), left)
    return pairs.withColumn("other", F.coalesce(F.lead(right).over(w), F.first(right).over(w)))


def cohens_kappa(pairs: DataFrame, group: str) -> DataFrame:
    """(group, n, kappa) of two raters' labels (a, b); 1 where chance agreement is complete. Rows with a null label are left out."""
    known = pairs.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    cells = known.groupBy(group, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = cells.groupBy(group).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy(group, F.col("a").alias("label")).agg(F.sum("n").alias("na"))
    right = cells.groupBy(group, F.col("b").alias("label")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, [group, "label"]).groupBy(group).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("chance"))
    joined = total.join(chance, group, "left")
    po, pe = F.col("same") / F.col("n"), F.coalesce("chance", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return joined.select(group, "n", F.round(F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)), 4).alias("kappa"))


def fleiss_kappa(ratings: DataFrame, group: str, item: str, label: str) -> DataFrame:
    """(group, items, kappa) over items that all raters of the group's most-rated items rated; needs two ratings an item. 1 where chance agreement is complete."""
    cells = ratings.filter(F.col(label).isNotNull()).groupBy(group, item, label).agg(F.count(F.lit(1)).alias("n"))
    items = cells.groupBy(group, item).agg(F.sum("n").alias("raters"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agree"))
    most = items.groupBy(group).agg(F.max("raters").alias("raters"))
    full = items.join(most, [group, "raters"]).filter("raters >= 2")
    means = full.groupBy(group).agg(F.count(F.lit(1)).alias("items"), F.first("raters").alias("raters"), F.avg(F.col("agree") / (F.col("raters") * (F.col("raters") - 1))).alias("po"))
    shares = cells.join(full.select(group, item), [group, item]).groupBy(group, label).agg(F.sum("n").alias("n"))
    chance = shares.join(means.select(group, (F.col("items") * F.col("raters")).alias("all")), group).groupBy(group).agg(F.sum(F.pow(F.col("n") / F.col("all"), 2.0)).alias("pe"))
    return means.join(chance, group).select(group, "items", F.round(F.when(F.col("pe") == 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))), 4).alias("kappa"))


def stratified_sample(df: DataFrame, pool: str, score: str, row_id: str, strata: int = 10, each: int = 6) -> DataFrame:
    """Up to `each` rows of every score stratum of every pool, chosen by a hash of the id, with `stratum` from 1 (best)."""
    at = placed(df, pool, [F.col(score).desc(), F.col(row_id)])
    cut = at.withColumn("stratum", tile_of(F.col("n_before") + 1, F.col("pool_size"), strata)).drop("n_before", "n_upto", "pool_size")
    pick = Window.partitionBy(pool, "stratum").orderBy(F.md5(F.col(row_id).cast("string")), F.col(row_id))
    return cut.withColumn("__n", F.row_number().over(pick)).filter(F.col("__n") <= each).drop("__n")


def consensus(labels: DataFrame, keys: list[str], grade: str) -> DataFrame:
    """keys, `grade` (the lower median of all grades given) and n_labels."""
    return labels.groupBy(*keys).agg(F.expr(f"percentile_disc(0.5) within group (order by {grade})").alias("grade"), F.count(grade).alias("n_labels"))


def simplex_weights(beta: np.ndarray, defaults: np.ndarray, bound: float = 0.4) -> np.ndarray:
    """Default weights moved by each coefficient's pull, none by more than `bound` of itself, with the same sum."""
    w = defaults * (1 + bound * np.tanh(beta / 2))
    lo, hi = defaults * (1 - bound), defaults * (1 + bound)
    for _ in range(100):
        gap = defaults.sum() - w.sum()
        room = hi - w if gap > 0 else w - lo
        if abs(gap) < 1e-12 or room.sum() <= 0:
            break
        w = np.clip(w + gap * room / room.sum(), lo, hi)
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, counts: np.ndarray | None = None, rate: float = 0.5, l2: float = 1.0, rounds: int = 2000, tol: float = 1e-7) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of a ridge logistic regression by batch gradient descent; an example may stand for several."""
    k = np.ones(len(y)) if counts is None else counts
    beta, b0, n = np.zeros(x.shape[1]), 0.0, k.sum()
    for _ in range(rounds):
        z = x @ beta + b0
        p = np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))
        off = k * (p - y)
        g, g0 = x.T @ off / n + l2 * beta / n, float(off.sum() / n)
        beta, b0 = beta - rate * g, b0 - rate * g0
        if max(np.abs(g).max(initial=0), abs(g0)) < tol:
            break
    return beta, b0


def fit_preferences(examples: DataFrame, user: str, features: list[str], label: str, defaults: list[float], least: int = 20) -> DataFrame:
    """(user, n_pos, n_neg, weights): personal weights of users with `least` positive and negative examples, the defaults for others.

    Null features count as 0 and rows with a null label are left out. Equal examples are counted before a user's are put
    together, so a group holds distinct examples only.
    """
    schema = T.StructType([examples.schema[user], T.StructField("n_pos", T.IntegerType()), T.StructField("n_neg", T.IntegerType()), T.StructField("weights", T.ArrayType(T.DoubleType()))])
    base = np.array(defaults)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([label, *features])
        y, n = g[label].to_numpy(float), g["__n"].to_numpy(float)
        pos, neg = int(n[y == 1].sum()), int(n[y == 0].sum())
        w = base
        if min(pos, neg) >= least:
            w = simplex_weights(fit_logistic(g[features].to_numpy(float), y, n)[0], base)
        return pd.DataFrame([(g[user].iloc[0], pos, neg, np.round(w, 6).tolist())], columns=schema.names)

    known = examples.filter(F.col(user).isNotNull() & F.col(label).isNotNull()).select(user, label, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    return known.groupBy(user, label, *features).agg(F.count(F.lit(1)).alias("__n")).groupBy(user).applyInPandas(one, schema)


def peak_is_single(values: Column) -> Column:
    """Whether a list of scores rises to one peak and then falls, without reversal. True for fewer than three."""
    steps = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(values) - 1, F.lit(1))), lambda i: F.signum(F.get(values, i.cast("int")) - F.get(values, (i - 1).cast("int")))), lambda d: d != 0)
    turns = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda i: F.get(steps, i.cast("int")) - F.get(steps, (i - 1).cast("int"))), lambda d: d.isNotNull() & (d != 0))
    return (F.size(values) < 3) | ((F.size(turns) == 0) | ((F.size(turns) == 1) & (F.get(turns, 0) < 0)))
