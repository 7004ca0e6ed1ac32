"""Consolidation, the quality filter, and the profile of a sample table."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import filters, histograms, profile
from ..schema import q
from ..sources import folders, tables
from .acquire import union_sources


@dataclass(frozen=True)
class Consolidated:
    """The merged table as written, its row check, and its map summary."""

    path: str
    table: DataFrame
    reconciliation: DataFrame
    points: DataFrame


def consolidate(spark: SparkSession, parts: dict[str, DataFrame], root: str, stamp: str) -> Consolidated:
    """Union of conformed sources, written once; the check compares the written table with the parts."""
    merged = union_sources(parts)
    path = tables.write_snapshot(merged, root, stamp)
    table = spark.read.schema(merged.schema).parquet(path)
    return Consolidated(path, table, profile.merge_reconciliation(merged, table), profile.geo_summary(table))


@dataclass(frozen=True)
class Filtered:
    """The table that passed the quality filter, as written, and the filter's report."""

    path: str
    table: DataFrame
    report: DataFrame


def quality_filter(spark: SparkSession, root: str, target: str, stamp: str, ions=None, temperature: str = "temperature_in_c",
                   limit: float = 5.0, min_temperature: float = 10.0) -> Filtered:
    """Newest snapshot under ``root``, filtered by charge balance and temperature, written under ``target``.

    The error is kept as a column, so later filters on it can skip row groups.
    """
    table = spark.read.parquet(folders.latest_snapshot(spark, root))
    balanced = filters.ionic_balance_error(table, ions)
    condition = filters.quality_condition("ibe", temperature, limit, min_temperature)
    path = tables.write_snapshot(balanced.where(condition), target, stamp)
    return Filtered(path, spark.read.schema(balanced.schema).parquet(path), filters.filter_report(balanced, condition))


@dataclass(frozen=True)
class Profile:
    """Tables of a profile report."""

    columns: DataFrame
    rows: DataFrame
    numbers: DataFrame
    bins: DataFrame
    fine_bins: DataFrame
    categories: dict[str, DataFrame]
    fixed_bins: dict[str, DataFrame]
    years: dict[str, DataFrame]


def profile_report_tables(df: DataFrame, numeric: list[str], categories: list[str], k: int = 50,
                          fixed: dict[str, tuple[float, float, int]] | None = None, dates: Iterable[str] = ()) -> Profile:
    """Completeness by column and row, statistics and histograms of numbers, top categories of texts, rows per year.

    ``fixed`` names columns with the low end, high end and number of equal bins.
    """
    return Profile(profile.column_completeness(df), profile.row_completeness_histogram(df), profile.column_profile(df, numeric),
                   histograms.histogram(df, numeric), histograms.histogram_fd(df, numeric),
                   {c: profile.category_topk(df.select(q(c)), c, k) for c in categories},
                   {c: histograms.histogram_fixed(df, c, *ends, F.lit(c)) for c, ends in (fixed or {}).items()},
                   {c: profile.counts_by_year(df, c) for c in dates})
