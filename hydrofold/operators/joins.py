"""Joins of source sheets and of small reference tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import q
from .ranking import global_row_number


def join_sheets(fluid: DataFrame, *others: DataFrame | None, key: str = "well_or_spring_name") -> DataFrame:
    """Left joins on the well name; only possible if every sheet carries it.

    Whether a side is broadcast is left to adaptive execution, which knows the real sizes.
    """
    sheets = [s for s in others if s is not None]
    if not all(key in s.columns for s in [fluid, *sheets]):
        raise ValueError(f"a sheet lacks {key!r}; use positional_concat with an explicit order")
    return reduce(lambda left, right: left.join(right, key, "left"), sheets, fluid)


def positional_concat(first: DataFrame, second: DataFrame, order_first: str, order_second: str) -> DataFrame:
    """Rows of two frames side by side by their position in an explicit order; the longer one is padded.

    The positions come from a distributed row number, so neither frame passes through a single task.
    Of equal column names the first frame's stays.
    """
    left = global_row_number(first, order_first, output="_row")
    right = global_row_number(second, order_second, output="_row")
    right = right.select("_row", *[q(c) for c in right.columns if c not in left.columns])
    return left.join(right, "_row", "full_outer").drop("_row")


def grid_left_join(spark, x: int, y: int, aggregates: DataFrame) -> DataFrame:
    """Every cell of an x by y grid, null where ``aggregates`` has no row for it."""
    grid = spark.range(x * y).select(
        (F.col("id") % x).cast("int").alias("som_x"), F.floor(F.col("id") / x).cast("int").alias("som_y"))
    return grid.join(aggregates, ["som_x", "som_y"], "left")


def mask_cells(masks: list[tuple[int, int]]) -> Column:
    """(level, mask) pairs as an array of structs."""
    return F.array(*[F.struct(F.lit(level).alias("level"), F.lit(mask).cast("long").alias("mask")) for level, mask in masks])


def cross_masks(df: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """Every row with every (level, mask); the mask list is a literal bounded by the benchmark, so no join is needed."""
    return df.select("*", F.inline(mask_cells(masks)))
