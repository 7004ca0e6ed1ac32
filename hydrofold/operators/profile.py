"""Completeness, distribution and per-source summaries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.chemistry import total
from ..functions.cleaning import strip_transforms
from ..schema import DISPLAY_NAMES, q
from .ranking import exact_quantiles

PROFILE_PROBABILITIES = (0.01, 0.25, 0.5, 0.75, 0.99)


def unpivot(df: DataFrame, columns: Iterable[str], keep: Iterable[str] = (), name: str = "feature", value: str = "value") -> DataFrame:
    """Numeric columns as (feature, value) rows next to the kept columns, null values included."""
    cells = [F.struct(F.lit(c).alias(name), q(c).cast("double").alias(value)) for c in columns]
    return df.select(*[q(c) for c in keep], F.inline(F.array(*cells)))


def column_completeness(df: DataFrame) -> DataFrame:
    """Values per column from one pass over the table."""
    cells = [F.struct(F.lit(c).alias("column"), F.count(q(c)).alias("n_values")) for c in df.columns]
    return df.agg(F.count("*").alias("n"), F.array(*cells).alias("r")).select(
        F.inline("r"), "n").select("column", "n_values", (F.col("n") - F.col("n_values")).alias("n_null")
    ).orderBy(F.desc("n_values"), "column")


def column_profile(df: DataFrame, columns: list[str], probabilities=PROFILE_PROBABILITIES) -> DataFrame:
    """Counts, extremes, mean, sample deviation and exact quantiles of several columns in one pass each.

    Moments aggregate map-side; quantiles come from the distributed order statistics.
    """
    long = unpivot(df, columns)
    v = F.col("value")
    moments = long.groupBy("feature").agg(
        F.count("*").alias("n"), F.count(v).alias("n_values"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
    quantiles = exact_quantiles(long, ["feature"], "value", list(probabilities)).drop("total")
    named = [F.get("quantiles", F.lit(i)).alias(_percent(p)) for i, p in enumerate(probabilities)]
    return (
        moments.join(F.broadcast(quantiles), "feature", "left")  # one row per column
        .select("feature", "n", "n_values", (F.col("n") - F.col("n_values")).alias("n_null"),
                (F.col("n_values") / F.col("n")).alias("share"), "min", "max", "mean", "std", *named))


def _percent(p: float) -> str:
    return "median" if p == 0.5 else f"p{round(p * 100):02d}"


def row_completeness_histogram(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows per 10-percent bin of filled cells; bins are right-closed and the first holds zero.

    Also the number of fully filled rows and the percentage of all rows.
    """
    columns = columns or df.columns
    filled = total([q(c).isNotNull().cast("double") for c in columns]) / F.lit(float(len(columns))) * F.lit(100.0)
    bins = df.select(filled.alias("p")).select(
        F.greatest(F.ceil(F.col("p") / 10) - 1, F.lit(0)).cast("int").alias("bin"), (F.col("p") == 100).alias("full"))
    counts = bins.groupBy("bin").agg(F.count("*").alias("n"), F.count_if("full").alias("n_full"))
    whole = Window.partitionBy()  # ten rows
    grid = df.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    return (
        grid.join(F.broadcast(counts), "bin", "left").na.fill(0, ["n", "n_full"])
        .select("bin", "n", F.sum("n_full").over(whole).alias("complete_rows"),
                (F.col("n") / F.sum("n").over(whole) * 100.0).alias("percent")))


def counts_by_year(df: DataFrame, column: str, min_share: float = 0.5) -> DataFrame:
    """Rows per year of a date column; text counts as dates only if more than ``min_share`` of all rows parse."""
    parsed = df.select(F.try_to_timestamp(q(column).cast("string")).alias("t"))
    years = parsed.groupBy(F.year("t").alias("year")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()  # one row per year
    share = F.sum(F.when(F.col("year").isNotNull(), F.col("n")).otherwise(0)).over(whole) / F.sum("n").over(whole)
    return years.withColumn("_share", share).where(
        (F.col("_share") > min_share) & F.col("year").isNotNull()).drop("_share").orderBy("year")


def category_topk(df: DataFrame, column: str, k: int = 20, rest: bool = True) -> DataFrame:
    """The ``k`` most frequent texts (ties by text) and, as a null category, the sum of the others."""
    counts = df.where(q(column).isNotNull()).groupBy(q(column).cast("string").alias("category")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "category").limit(k).select("category", "n", F.lit(False).alias("is_rest"))
    if not rest:
        return top
    others = (
        counts.join(F.broadcast(top.select("category")), "category", "left_anti")  # k rows
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).where(F.col("n") > 0)
        .select(F.lit(None).cast("string").alias("category"), "n", F.lit(True).alias("is_rest")))
    return top.unionByName(others)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per trimmed text, null included."""
    return df.groupBy(F.trim(q(column)).alias("value")).agg(F.count("*").alias("n"))


def summary_by_source(df: DataFrame, column: str, source: str = "Database_number", name: str = "Database_name",
                      order: str = "sample_id", unnamed: str = "Unbekannt") -> DataFrame:
    """Per source: rows, values, missing, percentages, extremes, mean, median, and the name on its first row.

    A source may hold a third of all rows: sums combine map-side, and the median never gathers a source in one task.
    """
    v, n = q(column), F.count("*")
    rows = df.where(q(source).isNotNull())
    base = rows.groupBy(source).agg(
        n.alias("n"), F.count(v).alias("n_values"), (n - F.count(v)).alias("n_missing"),
        (F.count(v) / n * 100.0).alias("percent_values"), ((n - F.count(v)) / n * 100.0).alias("percent_missing"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
        F.coalesce(F.min_by(F.when(q(name).isNotNull(), q(name)), F.when(q(name).isNotNull(), q(order))), F.lit(unnamed)).alias("name"))
    medians = exact_quantiles(rows, [source], column, [0.5]).select(source, F.get("quantiles", F.lit(0)).alias("median"))
    return base.join(medians, source, "left")


def category_coverage_by_source(df: DataFrame, column: str, source: str = "Database_name") -> DataFrame:
    """Per source: rows, values, percentage, and the sorted distinct values as one text.

    Values are made distinct before they are gathered, so a list is as long as the vocabulary.
    """
    counts = df.groupBy(source, column).agg(F.count("*").alias("_n"))
    value = q(column)
    n = F.sum("_n")
    n_values = F.coalesce(F.sum(F.when(value.isNotNull(), F.col("_n"))), F.lit(0))
    return counts.groupBy(source).agg(
        n.alias("n"), n_values.alias("n_values"), (n_values / n * 100.0).alias("percent"),
        F.array_join(F.sort_array(F.collect_list(value.cast("string"))), ", ").alias("categories"))


def merge_reconciliation(parts: DataFrame, merged: DataFrame, source: str = "Database_name") -> DataFrame:
    """Rows per part before and after the merge, with a match flag."""
    left = parts.groupBy(source).agg(F.count("*").alias("n_part"))
    right = merged.groupBy(source).agg(F.count("*").alias("n_merged"))
    return left.join(right, source, "full_outer").select(
        source, F.coalesce("n_part", F.lit(0)).alias("n_part"), F.coalesce("n_merged", F.lit(0)).alias("n_merged"),
        F.col("n_part").eqNullSafe(F.col("n_merged")).alias("matches"))


def geo_summary(df: DataFrame, latitude: str = "WGS84_latitude", longitude: str = "WGS84_longitude",
                zoom_cells=(45.0, 15.0, 5.0)) -> DataFrame:
    """Points per map cell for several cell sizes, with the cell's mean position; cell size 0 is the whole map."""
    lat, lon = q(latitude), q(longitude)
    cells = [F.struct(F.lit(0.0).alias("cell"), F.lit(0).cast("long").alias("lat_cell"), F.lit(0).cast("long").alias("lon_cell"))]
    cells += [F.struct(F.lit(s).alias("cell"), F.floor(lat / s).alias("lat_cell"), F.floor(lon / s).alias("lon_cell")) for s in zoom_cells]
    points = df.where(lat.isNotNull() & lon.isNotNull()).select(lat.alias("_lat"), lon.alias("_lon"), F.inline(F.array(*cells)))
    return points.groupBy("cell", "lat_cell", "lon_cell").agg(
        F.count("*").alias("n"), F.avg("_lat").alias("latitude"), F.avg("_lon").alias("longitude"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values."""
    return df.where(q(column).isNotNull()).select(q(column).alias("value")).distinct()


def label_features(features: DataFrame, feature: str = "feature") -> DataFrame:
    """Transformed feature names with their base name, display name and unit; other columns are kept."""
    base = strip_transforms(q(feature))
    names = F.create_map(*[F.lit(x) for pair in DISPLAY_NAMES.items() for x in pair])
    rest = [q(c) for c in features.columns if c != feature]
    return features.select(
        feature, base.alias("base"), F.coalesce(F.try_element_at(names, base), base).alias("display_name"),
        F.when(base.contains("_in_"), F.substring_index(base, "_in_", -1)).otherwise("").alias("unit"), *rest)
