"""What sets clusters apart: means, classes, profiles, rank tests, densities, ranges, importances."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.normal import two_sided_p
from ..schema import q
from ..session import checkpointed
from .forests import FOREST_ROWS, binned, folded, grow, importances
from .profile import unpivot
from .ranking import ranked_values

CELL = ["som_x", "som_y"]
# fixed value: the largest group whose rank test is exact
EXACT_ROWS = 8
#: Rows per task of a forest over all clusters, which keeps each row with its number of draws for every tree.
FOREST_TASK_ROWS = 250_000


def cluster_means(df: DataFrame, columns: list[str], by: list[str] = CELL) -> DataFrame:
    """Mean of every column per cluster, in one pass."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(q(c)).alias(c) for c in columns])


def cluster_category_counts(df: DataFrame, column: str, by: list[str] = CELL) -> DataFrame:
    """Rows per cluster and class."""
    return df.where(q(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))


def cluster_mode(df: DataFrame, column: str, by: list[str] = CELL) -> DataFrame:
    """Most frequent class per cluster, the smallest on a tie, null without any; counts combine before clusters meet."""
    counts = df.groupBy(*by, column).agg(F.count(q(column)).alias("_n"))
    best = F.min(F.when(q(column).isNotNull(), F.struct((-F.col("_n")).alias("rank"), q(column).alias("value"))))
    return counts.groupBy(*by).agg(best.alias("_best")).select(*by, F.col("_best.value").alias(column))


def cluster_distinct(df: DataFrame, column: str, by: list[str] = CELL) -> DataFrame:
    """Sorted distinct classes per cluster as one text."""
    classes = df.where(q(column).isNotNull()).select(*by, q(column).alias("_c")).distinct()
    return classes.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list("_c")), ", ").alias(column))


def cluster_profile(df: DataFrame, columns: list[str], by: list[str] = CELL, min_count: int = 3) -> DataFrame:
    """Per cluster and feature: mean inside and outside, standard score of the mean, and their ratio.

    The rest of a cluster is the total minus the cluster, so the table is read once. Pairs with fewer than
    ``min_count`` values on either side or without spread are left out.
    """
    v = F.col("value")
    parts = unpivot(df, columns, by).groupBy(*by, "feature").agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.var_samp(v).alias("_var"))
    whole = Window.partitionBy("feature")  # one row per cluster
    # Pooled variances of the clusters give the overall deviation without a second pass.
    within = F.coalesce(F.col("_var"), F.lit(0.0)) * F.greatest(F.col("n") - 1, F.lit(0))
    joined = parts.withColumns({"n_all": F.sum("n").over(whole), "s_all": F.sum("s").over(whole), "_within": F.sum(within).over(whole)})
    grand = F.try_divide(F.col("s_all"), F.col("n_all"))
    deviation = F.try_divide(F.col("s"), F.col("n")) - grand
    joined = joined.withColumn("_between", F.sum(F.coalesce(F.col("n") * deviation * deviation, F.lit(0.0))).over(whole))
    std = F.sqrt(F.try_divide(F.col("_within") + F.col("_between"), F.col("n_all") - 1))
    mean_in = F.try_divide(F.col("s"), F.col("n"))
    mean_rest = F.try_divide(F.col("s_all") - F.col("s"), F.col("n_all") - F.col("n"))
    return joined.withColumns({
        "n_rest": F.col("n_all") - F.col("n"), "mean_cluster": mean_in, "mean_rest": mean_rest,
        "z_score": F.try_divide(mean_in - grand, std), "factor": F.try_divide(mean_in, mean_rest),
    }).where((F.col("n") >= min_count) & (F.col("n_rest") >= min_count) & F.col("z_score").isNotNull()).select(
        *by, "feature", "n", "n_rest", "mean_cluster", "mean_rest", "z_score", "factor")


def mann_whitney(df: DataFrame, columns: list[str], by: list[str] = CELL, min_count: int = 3) -> DataFrame:
    """Two-sided rank test of every cluster against the rest, for all clusters and features at once.

    Values are counted per cluster first; ranks come from the distributed order statistics. Returns the
    U statistic, the tie-corrected normal score with continuity correction, both sizes, and whether values are tied.
    """
    long = unpivot(df, columns, by).where(F.col("value").isNotNull())
    ranks = ranked_values(long, ["feature"], "value")
    ties = ranks.groupBy("feature").agg(
        F.max("total").alias("total"), F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("tie_term"))
    per_cluster = long.groupBy(*by, "feature", "value").agg(F.count("*").alias("n_in"))
    rank = F.col("before") + (F.col("n") + 1) / 2
    sums = (per_cluster.join(ranks.select("feature", "value", "n", "before"), ["feature", "value"])
            .groupBy(*by, "feature").agg(F.sum("n_in").alias("n1"), F.sum(F.col("n_in") * rank).alias("rank_sum")))
    joined = sums.join(F.broadcast(ties), "feature").withColumns({  # one row per feature
        "n2": F.col("total") - F.col("n1"), "tied": F.col("tie_term") > 0})
    n, n1, n2 = (F.col(c).cast("double") for c in ("total", "n1", "n2"))
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("tie_term"), n * (n - 1))))
    score = F.try_divide(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5, spread)
    return joined.where((n1 >= min_count) & (n2 >= min_count)).select(
        *by, "feature", "n1", "n2", u.alias("u"), score.alias("score"), "tied")


def exact_p(n1: int, n2: int, u: float) -> float:
    """Two-sided p-value of U without ties: all ways to rank ``n1`` of ``n1 + n2`` rows are equally likely."""
    small, other = sorted((n1, n2))
    ways = np.zeros((small + 1, small * other + 1))  # by rows taken and their U
    ways[0, 0] = 1.0
    for place in range(small + other):
        for taken in range(min(small, place + 1), 0, -1):
            step = place - taken + 1  # rows of the other side below this one
            if step <= other:
                ways[taken, step:] += ways[taken - 1, :ways.shape[1] - step]
    chance = ways[small] / ways[small].sum()
    at = int(round(max(u, n1 * n2 - u)))
    return float(min(1.0, 2 * chance[at:].sum()))


def p_value(table: DataFrame, score: str = "score") -> DataFrame:
    """Add the two-sided p-value of ``mann_whitney``'s rows.

    It is exact where a side has at most ``EXACT_ROWS`` rows and no values are tied, else that of the normal score, and 1
    where the score is undefined.
    """
    @F.pandas_udf("double")
    def tail(scores: pd.Series, n1: pd.Series, n2: pd.Series, u: pd.Series, tied: pd.Series) -> pd.Series:
        p = np.minimum(two_sided_p(np.maximum(scores.fillna(0.0).to_numpy(), 0.0)), 1.0)
        for i in np.flatnonzero((np.minimum(n1, n2) <= EXACT_ROWS) & ~tied.astype(bool)):
            p[i] = exact_p(int(n1[i]), int(n2[i]), float(u[i]))
        return pd.Series(p)

    return table.withColumn("p_value", tail(q(score), "n1", "n2", "u", "tied"))


def tested_profile(df: DataFrame, columns: list[str], by: list[str] = CELL) -> DataFrame:
    """Profile with p-values."""
    tests = p_value(mann_whitney(df, columns, by)).select(*by, "feature", "u", "score", "p_value")
    return cluster_profile(df, columns, by).join(tests, [*by, "feature"])


def top_discriminators(profile: DataFrame, n: int = 10, by: list[str] = CELL) -> DataFrame:
    """The first ``n`` features per cluster by p-value, then by size of the standard score."""
    order = Window.partitionBy(*by).orderBy(
        *([F.asc("p_value")] if "p_value" in profile.columns else []), F.desc(F.abs("z_score")), "feature")
    return profile.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def log_range(df: DataFrame, columns: list[str], by: list[str] = CELL, linear: Iterable[str] = ("ph", "pH")) -> DataFrame:
    """Centre and one-deviation range per cluster and feature, on ln(1 + x) and transformed back; pH stays linear."""
    linear = list(linear)
    v = F.col("value")
    is_linear = F.col("feature").isin(linear)
    long = unpivot(df, columns, by).where(v.isNotNull()).withColumn("value", F.when(is_linear, v).otherwise(F.log1p(v)))
    stats = long.groupBy(*by, "feature").agg(F.count(v).alias("n"), F.avg(v).alias("mu"), F.stddev_samp(v).alias("sigma"))
    back = lambda x: F.when(is_linear, x).otherwise(F.expm1(x))
    return stats.select(*by, "feature", "n", "sigma", back(F.col("mu")).alias("centre"),
                        F.when(F.col("sigma").isNotNull(), F.greatest(F.lit(0.0), back(F.col("mu") - F.col("sigma")))).alias("low"),
                        back(F.col("mu") + F.col("sigma")).alias("high"))


def kde(df: DataFrame, columns: list[str], by: list[str] = CELL, points: int = 100, linear: Iterable[str] = ("ph", "temperature"),
        min_count: int = 3) -> DataFrame:
    """Gaussian kernel density per group and feature on an even grid from its minimum to its maximum.

    Features are taken on a log10 axis except the linear ones; non-positive values are then left out.
    Bandwidth is n^(-1/5) deviations. No value is sampled away.
    """
    v = F.col("value")
    is_linear = F.col("feature").isin(list(linear))
    long = unpivot(df, columns, by).where(v.isNotNull() & (is_linear | (v > 0))).withColumn(
        "value", F.when(is_linear, v).otherwise(F.log10(v)))
    return density(long, [*by, "feature"], points, min_count)


# Half a box is a quarter of a bandwidth, so that many moments leave less than 1e-13 of a value's weight out.
BOXES_PER_BANDWIDTH = 2
MOMENTS = 14
#: Kernels further away than so many bandwidths add less than 1e-20.
REACH = 10.0


def _hermite() -> np.ndarray:
    """Coefficients of t^j in the k-th Hermite polynomial, over k!: exp(t u - u^2 / 2) is the sum of row k at t times u^k."""
    table = np.zeros((MOMENTS, MOMENTS))
    table[0, 0] = table[1, 1] = 1.0
    for k in range(1, MOMENTS - 1):
        table[k + 1, 1:] = table[k, :-1]
        table[k + 1] -= k * table[k - 1]
    return table / np.cumprod([1.0, *range(1, MOMENTS)])[:, None]


def density(long: DataFrame, keys: list[str], points: int = 100, min_count: int = 3, tails: float = 0.0) -> DataFrame:
    """Gaussian kernel density of ``value`` per group of ``keys`` on an even grid over its range and ``tails`` bandwidths beyond.

    Values are summed up as moments of boxes of half a bandwidth, by which the kernels of a whole box are evaluated at
    a point. So the grid meets boxes instead of values: their number follows from range and bandwidth, and no value
    counts for more or less than the direct sum gives it (up to 1e-13).
    """
    v, h = F.col("value"), F.col("bandwidth")
    known = long.where(v.isNotNull())
    stats = known.groupBy(*keys).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.stddev_samp(v).alias("_std"))
    # Groups are usually few, but nothing bounds them here. They are written, so that the join is picked by their real size: where
    # the values come from a generator, Spark takes them for fewer bytes than they are and would broadcast them instead.
    usable = stats.where((F.col("n") >= min_count) & (F.col("_std") > 0)).withColumn(
        "bandwidth", F.col("_std") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).drop("_std")
    usable = checkpointed(usable, "density-groups")
    width = h / F.lit(float(BOXES_PER_BANDWIDTH))
    centre = F.col("low") + (F.col("_box") + 0.5) * width
    boxed = known.select(*keys, "value").join(usable, keys).withColumn("_box", F.floor((v - F.col("low")) / width))
    moments = boxed.withColumn("_u", (v - centre) / h).groupBy(*keys, "n", "low", "high", "bandwidth", "_box").agg(
        F.count("*").cast("double").alias("_m0"), *[F.sum(F.pow("_u", F.lit(float(k)))).alias(f"_m{k}") for k in range(1, MOMENTS)])
    hermite = _hermite()
    terms = lambda j: reduce(Column.__add__, [F.col(f"_m{k}") * F.lit(float(hermite[k, j])) for k in range(MOMENTS) if hermite[k, j]])
    start = F.col("low") - F.lit(tails) * h
    step = (F.col("high") - F.col("low") + F.lit(2 * tails) * h) / F.lit(points - 1)
    first = F.greatest(F.lit(0), F.ceil((centre - F.lit(REACH) * h - start) / step)).cast("int")
    last = F.least(F.lit(points - 1), F.floor((centre + F.lit(REACH) * h - start) / step)).cast("int")
    met = moments.select(*keys, "n", "bandwidth", start.alias("_start"), step.alias("_step"), centre.alias("_centre"), *[terms(j).alias(f"_c{j}") for j in range(MOMENTS)],
                         F.explode(F.when(first <= last, F.sequence(first, last))).alias("point"))
    placed = met.withColumn("x", F.col("_start") + F.col("_step") * F.col("point")).withColumn("_t", (F.col("x") - F.col("_centre")) / h)
    series = reduce(lambda sum_, j: sum_ * F.col("_t") + F.col(f"_c{j}"), reversed(range(MOMENTS - 1)), F.col(f"_c{MOMENTS - 1}"))
    mass = placed.groupBy(*keys, "point", "x", "n", "bandwidth").agg(F.sum(F.exp(F.col("_t") * F.col("_t") * -0.5) * series).alias("mass"))
    found = usable.select(*keys, "n", "bandwidth", start.alias("_start"), step.alias("_step"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    grid = found.select(*keys, "n", "bandwidth", "point", (F.col("_start") + F.col("_step") * F.col("point")).alias("x"))
    return grid.join(mass.select(*keys, "point", "mass"), [*keys, "point"], "left").select(
        *keys, "point", "x", "n", (F.coalesce("mass", F.lit(0.0)) / (F.col("n") * h * F.lit(float(np.sqrt(2 * np.pi))))).alias("density"))


def _forest(trees: int, depth: int, seed: int) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed)


def _importances(spark, columns: list[str], values, keys: dict) -> DataFrame:
    rows = [(*keys.values(), c, float(values[i])) for i, c in enumerate(columns)]
    schema = ", ".join([f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in keys.items()] + ["feature string", "importance double"])
    return spark.createDataFrame(rows, schema)


def rf_importance_global(df: DataFrame, columns: list[str], by: list[str] = CELL, trees: int = 100, depth: int = 5,
                         seed: int = 42) -> DataFrame:
    """Importance of every feature for telling all clusters apart, from a random forest on complete rows.

    Fewer than ``FOREST_ROWS`` rows or a single cluster give no row.
    """
    complete = df.dropna("any", subset=[*columns, *by])
    labelled = complete.withColumn("_cluster", F.concat_ws(",", *[q(c).cast("string") for c in by]))
    rows = VectorAssembler(inputCols=columns, outputCol="_x").transform(labelled).select("_x", "_cluster").persist()
    try:
        counts = rows.groupBy(F.spark_partition_id().alias("_task"), "_cluster").agg(F.count("*").alias("n"))
        parts = counts.groupBy("_task").agg(F.sum("n").alias("n"), F.min("_cluster").alias("low"), F.max("_cluster").alias("high"))
        size = parts.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.min("low").alias("low"), F.max("high").alias("high")).first()
        if (size["n"] or 0) < FOREST_ROWS or size["low"] == size["high"]:
            return df.sparkSession.createDataFrame([], "scope string, feature string, importance double")
        indexed = StringIndexer(inputCol="_cluster", outputCol="_y", stringOrderType="alphabetAsc").fit(rows).transform(rows)
        dealt = indexed.select("_x", "_y")
        if size["most"] > FOREST_TASK_ROWS:
            dealt = dealt.repartition(max(-(-size["n"] // FOREST_TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism))
        model = _forest(trees, depth, seed).fit(dealt)
    finally:
        rows.unpersist()
    return _importances(df.sparkSession, columns, model.featureImportances.toArray(), {"scope": "global"})


def rf_importance_local(df: DataFrame, columns: list[str], by: list[str] = CELL, trees: int = 100, depth: int = 5,
                        seed: int = 42) -> DataFrame:
    """The same for every cluster against the rest; all forests are grown in the same passes, one for each level."""
    schema = ", ".join([f"{c} int" for c in by] + ["feature string", "importance double"])
    data = binned(df, columns, by)
    if data is None:
        return df.sparkSession.createDataFrame([], schema)
    data = folded(data, trees, seed)
    rows = data.rows.persist()
    try:
        values = importances(grow(replace(data, rows=rows), trees, depth, seed)[1])
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame([(*cell, c, float(values[i, j])) for i, cell in enumerate(data.cells) for j, c in enumerate(columns)], schema)


def top_importances(importances: DataFrame, n: int = 3, by: list[str] = CELL) -> DataFrame:
    """The ``n`` strongest features per cluster, ties by name."""
    order = Window.partitionBy(*by).orderBy(F.desc("importance"), "feature")
    return importances.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
