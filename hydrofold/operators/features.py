"""Feature preparation: skew, log, normal scores, scaling, splits, principal components.

Every fit is one distributed aggregation whose result (a few numbers per column) comes to the driver and
returns as literals, so applying it adds no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.normal import inverse_normal
from ..schema import q
from .profile import unpivot
from .ranking import exact_quantiles, hash_order

# fixed values: resolution of the normal scores and their clipping probability
QUANTILES = 1000
CLIP_PROBABILITY = 1e-7


def select_features(columns: Iterable[str], wanted: Iterable[str]) -> tuple[list[str], dict[str, str | None]]:
    """Per wanted feature the normal scores of its logs, else its normal scores, else the raw column, else nothing."""
    columns = list(columns)
    report: dict[str, str | None] = {}
    for feature in wanted:
        scores = [c for c in columns if c.startswith(feature) and "_gauss" in c]
        logs = [c for c in scores if "_log_gauss" in c]
        report[feature] = (logs or scores or [feature if feature in columns else None])[0]
    return [c for c in report.values() if c], report


def mapping_table(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """The choice of ``select_features`` as rows, with the number of values behind each."""
    _, report = select_features(df.columns, wanted)
    cells = [
        F.struct(F.lit(feature).alias("feature"), F.lit(column).cast("string").alias("column"),
                 F.lit(column == feature).alias("is_raw"), (F.count(q(column)) if column else F.lit(0).cast("long")).alias("n_values"))
        for feature, column in report.items()
    ]
    return df.agg(F.array(*cells).alias("r")).select(F.inline("r"))


def skewness_g1(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bias-corrected skewness and minimum per column, one pass; null below three values."""
    cells = []
    for c in columns:
        n = F.count(q(c)).cast("double")
        corrected = F.when(n > 2, F.skewness(q(c).cast("double")) * F.sqrt(n * (n - 1)) / (n - 2))
        cells.append(F.struct(F.lit(c).alias("feature"), corrected.alias("skewness"), F.min(q(c)).cast("double").alias("min"),
                              F.count(q(c)).alias("n")))
    return df.agg(F.array(*cells).alias("r")).select(F.inline("r"))


def log_transform(df: DataFrame, columns: list[str], threshold: float = 1.0) -> tuple[DataFrame, list[str]]:
    """Add ``<c>_log`` = ln(1 + x) for skewed non-negative columns; the list names the column to use for each.

    Columns without any value are left out of the list.
    """
    facts = {row["feature"]: row for row in skewness_g1(df, columns).collect()}  # one row per column
    logs, names = {}, []
    for c in columns:
        fact = facts[c]
        if fact["n"] == 0:
            continue
        skewed = fact["skewness"] is not None and abs(fact["skewness"]) > threshold and fact["min"] >= 0
        names.append(f"{c}_log" if skewed else c)
        if skewed:
            logs[f"{c}_log"] = F.log1p(q(c))
    return (df.withColumns(logs) if logs else df), names


def quantile_grid(df: DataFrame, columns: list[str], size: int) -> DataFrame:
    """(feature, total, quantiles) on ``size`` evenly spaced probabilities from 0 to 1."""
    return exact_quantiles(unpivot(df, columns), ["feature"], "value", np.linspace(0.0, 1.0, size).tolist())


def gaussianize(df: DataFrame, columns: list[str], min_values: int = 10) -> tuple[DataFrame, list[str]]:
    """Add ``<c>_gauss``: normal scores through the empirical distribution; nulls stay null.

    Ties get the middle of the probabilities their value spans; the ends are clipped. Columns with fewer
    than ``min_values`` values are skipped.
    """
    counts = df.agg(*[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    by_size: dict[int, list[str]] = {}
    for i, c in enumerate(columns):
        if counts[i] >= min_values:
            by_size.setdefault(min(QUANTILES, counts[i]), []).append(c)
    grids = {row["feature"]: np.array(row["quantiles"]) for size, names in by_size.items()
             for row in quantile_grid(df, names, size).collect()}  # at most QUANTILES numbers per column
    scores = {f"{c}_gauss": _normal_scores(grids[c])(q(c).cast("double")) for c in columns if c in grids}
    return (df.withColumns(scores) if scores else df), list(scores)


def _normal_scores(grid: np.ndarray):
    references = np.linspace(0.0, 1.0, len(grid))

    @F.pandas_udf("double")
    def scores(values: pd.Series) -> pd.Series:
        x = values.to_numpy(dtype=float, na_value=np.nan)
        out = np.full(len(x), np.nan)
        known = ~np.isnan(x)
        v = x[known]
        upward = np.interp(v, grid, references)
        downward = -np.interp(-v, -grid[::-1], -references[::-1])
        p = 0.5 * (upward + downward)
        p = np.where(v <= grid[0], 0.0, np.where(v >= grid[-1], 1.0, p))
        out[known] = inverse_normal(np.clip(p, CLIP_PROBABILITY, 1.0 - CLIP_PROBABILITY))
        return pd.Series(out)  # NaN becomes null

    return scores


def split_label(key: Column, test_fraction: float = 0.1, seed: int = 42) -> Column:
    """``Test`` or ``Train`` by the key's seeded hash: no shuffle, the same after any re-run."""
    limit = f"{int(test_fraction * 16 ** 8):08x}"
    return F.when(F.substring(hash_order(key, seed), 1, 8) < limit, "Test").otherwise("Train")


def fold_of(key: Column, folds: int = 5, seed: int = 42) -> Column:
    """Fold number by the key's seeded hash."""
    return F.pmod(F.conv(F.substring(hash_order(key, seed), 9, 7), 16, 10).cast("long"), F.lit(folds)).cast("int")


def _literals(values: Iterable[float]) -> list[Column]:
    return [F.lit(float(v)) for v in values]


@dataclass(frozen=True)
class Standard:
    """Mean and population deviation per column; a constant column has scale 1."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (q(c) - m) / s for c, m, s in zip(self.columns, _literals(self.mean), _literals(self.scale))})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: q(c) * s + m for c, m, s in zip(self.columns, _literals(self.mean), _literals(self.scale))})


def standardize(train: DataFrame, columns: list[str]) -> Standard:
    """Fit on the training rows; a column without values gets mean 0 and scale 1."""
    row = train.agg(*[f(q(c).cast("double")) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    mean = [0.0 if v is None else v for v in row[0::2]]
    scale = [v if v else 1.0 for v in row[1::2]]
    return Standard(tuple(columns), tuple(mean), tuple(scale))


def quantile_bounds(train: DataFrame, columns: list[str], threshold: float = 0.02) -> dict[str, tuple[float, float]]:
    """Lower and upper clipping bound per column from the training rows."""
    rows = exact_quantiles(unpivot(train, columns), ["feature"], "value", [threshold, 1 - threshold]).collect()
    return {row["feature"]: tuple(row["quantiles"]) for row in rows}  # one row per column


def clipped(column: Column, low: Column | float, high: Column | float) -> Column:
    """Value moved into the bounds, null stays null."""
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(column.isNotNull(), F.least(F.greatest(column, low), high))


def quantile_clip(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Columns clipped to stored bounds."""
    return df.withColumns({c: clipped(q(c), low, high) for c, (low, high) in bounds.items()})


def clip_for_metrics(results: DataFrame, bounds: DataFrame, feature: str = "feature") -> DataFrame:
    """Original and imputed values clipped to their feature's bounds; features without bounds stay as they are."""
    joined = results.join(F.broadcast(bounds), feature, "left")  # one row per feature
    return joined.withColumns({
        c: F.when(F.col("low").isNull(), F.col(c)).otherwise(clipped(F.col(c), F.col("low"), F.col("high")))
        for c in ("original", "imputed")}).drop("low", "high")


def min_max(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Minimum and range per column; a constant column has range 1, so it scales to 0."""
    row = df.agg(*[f(q(c).cast("double")) for c in columns for f in (F.min, F.max)]).first()
    return {c: (row[2 * i], (row[2 * i + 1] - row[2 * i]) or 1.0) for i, c in enumerate(columns)}


def min_max_scale(df: DataFrame, limits: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    """Columns scaled to [0, 1]."""
    return df.withColumns({f"{c}{suffix}": (q(c) - F.lit(low)) / F.lit(width) for c, (low, width) in limits.items()})


def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sample covariances (a, b, value) of every column pair over complete rows, one pass."""
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.covar_samp(q(a), q(b)).alias("value"))
             for a, b in combinations_with_replacement(columns, 2)]
    return df.dropna("any", subset=columns).agg(F.array(*cells).alias("r")).select(F.inline("r"))


@dataclass(frozen=True)
class Components:
    """Leading principal components: mean, unit directions (largest entry positive), variances."""

    mean: np.ndarray
    directions: np.ndarray
    variances: np.ndarray


def pca(df: DataFrame, columns: list[str], k: int = 2) -> Components:
    """Distributed covariance, then the eigenvectors of a columns x columns matrix on the driver."""
    complete = df.dropna("any", subset=columns)
    mean = np.array([v or 0.0 for v in complete.agg(*[F.avg(q(c)) for c in columns]).first()])
    matrix = np.zeros((len(columns), len(columns)))
    for row in covariance(complete, columns).collect():  # columns x columns numbers
        i, j = columns.index(row["a"]), columns.index(row["b"])
        matrix[i, j] = matrix[j, i] = row["value"] or 0.0
    variances, vectors = np.linalg.eigh(matrix)
    order = np.argsort(variances)[::-1][:k]
    directions = vectors[:, order].T
    signs = np.sign(directions[np.arange(len(order)), np.abs(directions).argmax(axis=1)])
    return Components(mean, directions * signs[:, None], np.maximum(variances[order], 0.0))


def pca_projection(df: DataFrame, columns: list[str], components: Components) -> DataFrame:
    """Coordinates ``pc1``, ``pc2``, ... as column expressions."""
    def coordinate(direction) -> Column:
        terms = [(q(c) - F.lit(float(m))) * F.lit(float(w)) for c, m, w in zip(columns, components.mean, direction)]
        return sum(terms[1:], terms[0])

    return df.withColumns({f"pc{i + 1}": coordinate(v) for i, v in enumerate(components.directions)})
