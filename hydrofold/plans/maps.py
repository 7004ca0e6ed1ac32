"""Map analysis of one feature selection, and sweeps over selections and map sizes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import clusters, som
from ..operators.features import min_max, min_max_scale, select_features
from ..operators.joins import grid_left_join
from ..schema import q
from ..session import checkpointed

# fixed values: fewest rows worth a map, and the temperature from which samples count
MIN_ROWS = 50
MIN_TEMPERATURE = 10.0


@dataclass(frozen=True)
class MapReport:
    """Everything an analysis yields; each table is a DataFrame over the assigned samples, which are written once."""

    codebook: som.Codebook
    assigned: DataFrame
    quality: DataFrame
    means: DataFrame
    rock: DataFrame
    rock_counts: DataFrame | None
    periods: DataFrame | None
    profile: DataFrame
    densities: DataFrame
    importances: DataFrame
    local_importances: DataFrame
    ranges: DataFrame


def map_rows(df: DataFrame, columns: list[str], temperature: str = "temperature") -> DataFrame:
    """Rows warm enough or of unknown temperature, complete in ``columns``, with scaled copies ``<c>_s``."""
    warm = df.where((q(temperature) >= MIN_TEMPERATURE) | q(temperature).isNull()) if temperature in df.columns else df
    complete = warm.dropna("any", subset=columns)
    return min_max_scale(complete, min_max(complete, columns), "_s")


def som_analysis(df: DataFrame, selection: list[str], report_columns: list[str], x: int = 4, y: int = 4, epochs: int = som.EPOCHS,
                 temperature: str = "temperature", rock: str = "rock_type", period: str = "period", min_rows: int = MIN_ROWS) -> MapReport | None:
    """Fit a map on the selected features and describe its clusters; None with too few rows.

    Only the scaled features are persisted, for the passes of the fit; the reports read the assigned rows from the work folder.
    Log ranges are given for the three features that matter most in each cluster.
    """
    columns, _ = select_features(df.columns, selection)
    if df.dropna("any", subset=columns).limit(min_rows).count() < min_rows:
        return None
    rows, scaled = map_rows(df, columns, temperature), [f"{c}_s" for c in columns]
    fitted = rows.select([q(c) for c in scaled]).persist()
    try:
        book = som.som_fit(fitted, scaled, x, y, epochs=epochs)
    finally:
        fitted.unpersist()
    assigned = checkpointed(som.som_assign(rows, book), "assigned")
    local = clusters.rf_importance_local(assigned, report_columns)
    top = clusters.top_importances(local, 3).select("som_x", "som_y", "feature", "rank")
    return MapReport(
        codebook=book, assigned=assigned, quality=som.som_quality(assigned),
        means=grid_left_join(df.sparkSession, x, y, clusters.cluster_means(assigned, report_columns)),
        rock=clusters.cluster_mode(assigned, rock),
        rock_counts=clusters.cluster_category_counts(assigned, rock) if rock in assigned.columns else None,
        periods=clusters.cluster_distinct(assigned, period) if period in assigned.columns else None,
        profile=clusters.top_discriminators(clusters.tested_profile(assigned, report_columns)),
        densities=clusters.kde(assigned, report_columns),
        importances=clusters.rf_importance_global(assigned, report_columns), local_importances=local,
        ranges=clusters.log_range(assigned, report_columns).join(top, ["som_x", "som_y", "feature"]))


def som_sweep(df: DataFrame, selections: dict[str, list[str]], sizes=range(2, 11), epochs: int = som.EPOCHS,
              temperature: str = "temperature", min_rows: int = MIN_ROWS) -> DataFrame:
    """Errors of every selection on every square map size; selections with too few rows are skipped."""
    errors = []
    for label, selection in selections.items():
        columns, _ = select_features(df.columns, selection)
        rows = map_rows(df, columns, temperature).select([q(f"{c}_s") for c in columns]).persist()
        try:
            if rows.limit(min_rows).count() < min_rows:
                continue
            books = som.som_fit_sizes(rows, rows.columns, [(size, size) for size in sizes], epochs=epochs)
            measured = [som.som_quality(som.som_assign(rows, book)).withColumn("size", F.lit(book.x)) for book in books]
            for error in reduce(DataFrame.unionByName, measured).collect():  # one row per size
                errors.append((label, error["size"], error["n"], error["quantization_error"], error["topographic_error"]))
        finally:
            rows.unpersist()
    return df.sparkSession.createDataFrame(
        errors, "label string, size int, n long, quantization_error double, topographic_error double")
