"""Histograms: bin edges from distributed statistics, then one grouped count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import q
from .profile import unpivot
from .ranking import exact_quantiles


def _counted(long: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per bin for bounds (low, high, bins); the last bin is closed, outside values are dropped."""
    v = F.col("value")
    width = (F.col("high") - F.col("low")) / F.col("bins")
    index = F.least(F.floor((v - F.col("low")) / width), F.col("bins") - 1)
    return (
        long.join(F.broadcast(bounds), keys)  # one row per column
        .where(v.between(F.col("low"), F.col("high")) & (F.col("high") > F.col("low")))
        .groupBy(*keys, F.col("low"), F.col("high"), F.col("bins"), index.cast("int").alias("bin"))
        .agg(F.count("*").alias("n")))


def histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: range from the minimum to p99 (p98 if the maximum exceeds ten times p99).

    The number of bins is the square root of the count, at most 60, or half of it below 30 values but at least 5.
    """
    long = unpivot(df, columns).where("value is not null")
    ends = long.groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("max"))
    cuts = exact_quantiles(long, ["feature"], "value", [0.98, 0.99])
    p98, p99, n = F.get("quantiles", F.lit(0)), F.get("quantiles", F.lit(1)), F.col("total")
    bins = F.when(n < 30, F.greatest(F.lit(5), F.floor(n / 2))).otherwise(F.least(F.lit(60), F.floor(F.sqrt(n))))
    bounds = ends.join(F.broadcast(cuts), "feature").select(  # one row per column
        "feature", "low", F.greatest(F.when(F.col("max") > p99 * 10, p98).otherwise(p99), F.col("low")).alias("high"),
        bins.cast("int").alias("bins"))
    return _counted(long, bounds, ["feature"])


def histogram_fd(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: Freedman-Diaconis bins over p1 to p99 (the full range if these coincide).

    The width comes from the values inside the range, 2 IQR / cube root of n; a zero width gives one bin.
    """
    long = unpivot(df, columns).where("value is not null")
    ends = long.groupBy("feature").agg(F.min("value").alias("_min"), F.max("value").alias("_max"))
    cuts = exact_quantiles(long, ["feature"], "value", [0.01, 0.99])
    p1, p99 = F.get("quantiles", F.lit(0)), F.get("quantiles", F.lit(1))
    span = ends.join(F.broadcast(cuts), "feature").select(  # one row per column
        "feature", F.when(p1 < p99, p1).otherwise(F.col("_min")).alias("low"), F.when(p1 < p99, p99).otherwise(F.col("_max")).alias("high"))
    inside = long.join(F.broadcast(span), "feature").where(F.col("value").between(F.col("low"), F.col("high")))
    quartiles = exact_quantiles(inside.select("feature", "value"), ["feature"], "value", [0.25, 0.75])
    iqr = F.get("quantiles", F.lit(1)) - F.get("quantiles", F.lit(0))
    width = F.lit(2.0) * iqr / F.pow(F.col("total").cast("double"), F.lit(1.0 / 3.0))
    bounds = span.join(F.broadcast(quartiles), "feature").withColumn("_w", width).select(
        "feature", "low", "high",
        F.when(F.col("_w") > 0, F.ceil((F.col("high") - F.col("low")) / F.col("_w"))).otherwise(1).cast("int").alias("bins"))
    return _counted(long, bounds, ["feature"])


def histogram_fixed(df: DataFrame, column: str, low: float, high: float, bins: int, series: Column) -> DataFrame:
    """Counts per (series, bin) over equal fixed bins; the last bin is closed."""
    v = q(column)
    width = (high - low) / bins
    index = F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return df.where(v.between(low, high)).groupBy(series.alias("series"), index.alias("bin")).agg(F.count("*").alias("n"))
