"""Row filters and their reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.chemistry import ionic_balance
from ..schema import q


def ionic_balance_error(df: DataFrame, ions=None, output: str = "ibe", **options) -> DataFrame:
    """Charge balance error in percent as a column; see ``functions.chemistry.ionic_balance``."""
    return df.withColumn(output, ionic_balance(df, ions, **options))


def quality_condition(ibe: str = "ibe", temperature: str = "temperature_in_c", limit: float = 5.0,
                      min_temperature: float = 10.0) -> Column:
    """|error| within the limit, and warm enough or of unknown temperature."""
    warm = (q(temperature) >= min_temperature) | q(temperature).isNull()
    return F.coalesce((F.abs(q(ibe)) <= limit) & warm, F.lit(False))


def filter_ibe_temperature(df: DataFrame, limit: float = 5.0, min_temperature: float = 10.0,
                           ibe: str = "ibe", temperature: str = "temperature_in_c") -> DataFrame:
    """Rows that pass the charge balance and temperature check."""
    return df.where(quality_condition(ibe, temperature, limit, min_temperature))


def filter_ibe_validity(df: DataFrame, variant: str = "strict", ions=None, output: str = "ibe", **options) -> DataFrame:
    """Rows whose charge balance is defined under a variant's threshold and unit rules."""
    return ionic_balance_error(df, ions, output, variant=variant, **options).where(q(output).isNotNull())


def filter_extremes(df: DataFrame, limit: float = 99.9, n: int = 3, ibe: str = "ibe", key: str = "sample_id") -> DataFrame:
    """The first ``n`` example rows beyond each end, by key."""
    high = df.where(q(ibe) > limit).orderBy(key).limit(n)
    low = df.where(q(ibe) < -limit).orderBy(key).limit(n)
    return high.unionByName(low)


def filter_valid_coordinates(df: DataFrame, latitude: str = "WGS84_latitude", longitude: str = "WGS84_longitude") -> DataFrame:
    """Rows with both coordinates."""
    return df.dropna(subset=[latitude, longitude])


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null in ``columns``."""
    return df.where(reduce(lambda a, b: a & b, [q(c).isNotNull() for c in columns]))


def any_present(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with at least one value in ``columns``."""
    return df.where(reduce(lambda a, b: a | b, [q(c).isNotNull() for c in columns]))


def filter_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows with a plausible value, both ends included."""
    return df.where(q(column).between(low, high))


def null_sentinel(df: DataFrame, column: str, sentinel: str = "Unknown") -> DataFrame:
    """A sentinel text becomes null."""
    return df.withColumn(column, F.when(q(column) != sentinel, q(column)))


def sentinel_report(df: DataFrame, column: str, sentinel: str = "Unknown") -> DataFrame:
    """Values before and after ``null_sentinel``."""
    after = F.count(F.when(q(column) != sentinel, 1))
    return df.agg(F.count(q(column)).alias("before"), after.alias("after"),
                  (F.count(q(column)) - after).alias("removed"))


def require_min_count(df: DataFrame, groups: list[str], n: int) -> DataFrame:
    """Groups with at least ``n`` rows, with their count."""
    return df.groupBy(*groups).agg(F.count("*").alias("n")).where(F.col("n") >= n)


def filter_report(df: DataFrame, kept: Column) -> DataFrame:
    """Rows before, kept, removed, and percent removed, in one pass."""
    n, n_kept = F.count("*"), F.count_if(kept)
    return df.agg(n.alias("original"), n_kept.alias("kept"), (n - n_kept).alias("removed"),
                  (F.try_divide((n - n_kept).cast("double"), n) * 100.0).alias("percent_removed"))


def ibe_quality_report(df: DataFrame, ibe: str = "ibe", limit: float = 5.0) -> DataFrame:
    """Rows with a defined balance, those within the limit, and shares."""
    n, good = F.count(q(ibe)), F.count_if(F.abs(q(ibe)) <= limit)
    return df.agg(
        n.alias("total"), good.alias("good"), (n - good).alias("bad"),
        F.try_divide(good.cast("double"), n).alias("good_share"),
        F.try_divide((n - good).cast("double"), n).alias("bad_share"))


def temperature_share(df: DataFrame, column: str, split: float = 10.0) -> DataFrame:
    """Count, cold and warm counts with shares, and mean of plausible temperatures."""
    n, cold = F.count(q(column)), F.count_if(q(column) < split)
    warm = F.count_if(q(column) >= split)
    return df.agg(
        n.alias("total"), cold.alias("below"), warm.alias("above"),
        F.try_divide(cold.cast("double"), n).alias("below_share"),
        F.try_divide(warm.cast("double"), n).alias("above_share"), F.avg(q(column)).alias("mean"))
