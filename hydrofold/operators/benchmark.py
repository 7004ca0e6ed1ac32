"""Mask-and-impute benchmark: hide known cells in every combination and compare what comes back."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..schema import q
from ..session import balanced
from .examples import mask_list, sample_fraction
from .features import Standard, quantile_bounds, quantile_clip, split_label, standardize
from .filters import any_present, complete_cases
from .joins import cross_masks, mask_cells
from .knn import CELL_ROWS, Blocks, _matrix, distinct_donors, knn_join, means_of_nearest, neighbour_mean, vector

# Rows per task before masking multiplies them by up to 50 masks per level.
TASK_ROWS = 2000
# The same where requests stay rows of their own and are only added up.
REQUEST_TASK_ROWS = 20_000
# Up to so many donors that hold every feature are copied to all tasks; a task then searches so many rows under so many masks.
WHOLE_DONORS = 1 << 19
SEARCH_TASK_ROWS = 65_536
SEARCH_MASKS = 4

Imputer = Callable[[DataFrame], DataFrame]
"""Takes requests (``request_id``, ``x`` with hidden cells null, ``mask``, ...) and adds ``imputed``, an array like ``x``."""


def knn_imputer(train: DataFrame, key: str, columns: list[str], k: int = 5, cell_rows: int = CELL_ROWS) -> Imputer:
    """Nearest-neighbour imputer over scaled training rows, which it must hold without nulls or per wanted feature."""
    d = len(columns)
    donors = train.select(q(key).alias("donor_id"), vector(columns).alias("y"))
    total, *counted = train.agg(F.count("*"), *[f(q(c)) for c in columns for f in (F.avg, F.count)]).first()
    means = F.array(*[F.lit(m).cast("double") for m in counted[0::2]])

    def impute_whole(requests: DataFrame) -> DataFrame:
        # Every donor holds every feature: one search serves all hidden cells of a request.
        joined = knn_join(requests.withColumn("target", F.lit(-1)), donors, d, k, cell_rows)
        # No lambda here: Spark compiles none.
        mean = lambda j: sum((F.coalesce(F.get("donor_values", F.lit(i * d + j)), F.lit(0.0)) for i in range(k)), F.lit(0.0)) / F.size("donors")
        cells = [F.coalesce(F.get("x", F.lit(j)), F.when(F.size("donors") > 0, mean(j)), F.get(means, F.lit(j))) for j in range(d)]
        return joined.withColumn("imputed", F.array(*cells)).drop("target", "distances", "donors", "donor_values")

    def impute_in_tasks(requests: DataFrame) -> DataFrame:
        table = distinct_donors(donors, k).toArrow()  # at most WHOLE_DONORS rows
        held = requests.sparkSession.sparkContext.broadcast(
            (_matrix(table.column("y"), d), table.column("donor_id").to_numpy().astype(np.int64), np.array([np.nan if m is None else m for m in counted[0::2]], float)))
        schema = T.StructType(requests.schema.fields + [T.StructField("imputed", T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = [b for b in batches if b.num_rows]
            if asked:
                values, keys, fallback = held.value
                x = np.vstack([_matrix(b.column("x"), d) for b in asked])
                filled = np.where(np.isnan(x), means_of_nearest(x, Blocks.build(values, keys), k), x)
                filled = np.where(np.isnan(filled), fallback, filled)
                for b in asked:
                    out, filled = filled[:b.num_rows].ravel(), filled[b.num_rows:]
                    offsets = np.arange(0, out.size + 1, d, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, pa.array(out, mask=np.isnan(out)))],
                                                     names=[*b.schema.names, "imputed"])

        return requests.mapInArrow(run, schema)

    def impute(requests: DataFrame) -> DataFrame:
        # Donors may differ by wanted feature: one request per hidden cell, gathered again by request.
        hidden = F.filter(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: F.get("x", j).isNull())
        cells = requests.select("request_id", "x", F.explode(hidden).alias("target")).withColumn(
            "request_id", F.concat_ws("/", "request_id", "target"))
        joined = knn_join(cells, donors, d, k, cell_rows)
        value = F.coalesce(neighbour_mean(F.col("target"), d), F.get(means, F.col("target")))
        per_request = joined.select(F.substring_index("request_id", "/", 1).alias("request_id"), "target", value.alias("_v")).groupBy(
            "request_id").agg(F.map_from_entries(F.collect_list(F.struct("target", "_v"))).alias("_filled"))  # at most d cells
        filled = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: F.coalesce(F.get("x", j), F.try_element_at("_filled", j)))
        # Spark does not see how many requests a row becomes and would broadcast them.
        return requests.join(per_request.hint("merge"), "request_id", "left").withColumn("imputed", filled).drop("_filled")

    if not total or any(n < total for n in counted[1::2]):
        return impute
    if total > WHOLE_DONORS:
        return impute_whole
    impute_in_tasks.masks_of_a_task = SEARCH_MASKS
    return impute_in_tasks


def mean_imputer(columns: list[str]) -> Imputer:
    """Every cell as the training mean, which is zero on the standard scale; the yardstick for the others."""
    return lambda requests: requests.withColumn("imputed", F.array(*[F.lit(0.0)] * len(columns)))


def prepared(df: DataFrame, key: str, columns: list[str], include_incomplete: bool = False, clip: float | None = None,
             test_fraction: float = 0.1, seed: int = 42) -> tuple[DataFrame, Standard]:
    """Rows with ``split`` and raw values, and the scaling fitted on the training rows."""
    rows = (any_present if include_incomplete else complete_cases)(df, columns).select(
        q(key), *[q(c) for c in columns], split_label(q(key), test_fraction, seed).alias("split"))
    if clip is not None:
        rows = quantile_clip(rows, quantile_bounds(rows.where("split = 'Train'"), columns, clip))
    return rows, standardize(rows.where("split = 'Train'"), columns)


def benchmark_requests(rows: DataFrame, key: str, columns: list[str], scaling: Standard, masks, seed: int = 42,
                       train_parts: int = 1, task_rows: int = TASK_ROWS, masks_of_a_task: int | None = None) -> DataFrame:
    """All test rows and one in ``train_parts`` training rows under every mask, hidden cells null on the standard scale.

    With ``masks_of_a_task`` a task has many rows under few masks, so that it searches alike requests together.
    """
    test = rows.where("split = 'Test'")
    train = rows.where("split = 'Train'")
    train = sample_fraction(train, key, train_parts, seed) if train_parts > 1 else train
    rows = test.unionByName(train)
    parts = [masks] if masks_of_a_task is None else [masks[i:i + masks_of_a_task] for i in range(0, len(masks), masks_of_a_task)]
    dealt = balanced(rows, key, task_rows) if masks_of_a_task is None else _dealt(rows, key, len(parts))
    scaled = scaling.transform(dealt.withColumn("original", vector(columns))).select(
        q(key), "split", "original", vector(columns).alias("full"), *([] if masks_of_a_task is None else ["_part"]))
    masked = cross_masks(scaled, masks) if masks_of_a_task is None else scaled.select("*", F.inline(reduce(
        lambda c, p: c.when(F.col("_part") == p[0], mask_cells(p[1])), enumerate(parts), F))).drop("_part")
    d = len(columns)
    bit = lambda j: F.col("mask").bitwiseAND(F.lit(1 << j)) != 0
    x = F.array(*[F.when(~bit(j), F.get("full", F.lit(j))) for j in range(d)])
    return masked.withColumns({"x": x, "request_id": F.concat_ws("-", q(key).cast("string"), F.col("mask").cast("string"))}).drop("full")


def _dealt(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """Rows once for each ``_part`` of the masks, a task for each part and for as many rows as a task searches."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-n // SEARCH_TASK_ROWS), -(-2 * cores // parts))
    copies = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    at = F.col("_part") * tasks + F.pmod(F.xxhash64(q(key)), F.lit(tasks)).cast("int")
    return copies.withColumn("_at", at).repartitionById(parts * tasks, "_at").drop("_at")


def mask_benchmark(df: DataFrame, key: str, columns: list[str], make_imputer: Callable[[DataFrame], Imputer],
                   include_incomplete: bool = False, cap: int | None = None, seed: int = 42, clip: float | None = None,
                   train_parts: int = 1, by_request: bool = False) -> DataFrame:
    """Long rows (key, feature, original, imputed, split, level, combination) for every hidden cell that was known, or
    with ``by_request`` the rows of ``request_rows``.

    Levels hide 1 to d-1 features in every combination, or in ``cap`` of them each. All rows are scored, or one in
    ``train_parts`` of the training rows. ``make_imputer`` gets all scaled training rows.
    """
    rows, scaling = prepared(df, key, columns, include_incomplete, clip, seed=seed)
    imputer = make_imputer(scaling.transform(rows.where("split = 'Train'")))
    requests = benchmark_requests(rows, key, columns, scaling, mask_list(len(columns), cap, seed), seed, train_parts,
                                  REQUEST_TASK_ROWS if by_request else TASK_ROWS, getattr(imputer, "masks_of_a_task", None))
    return (request_rows if by_request else result_rows)(imputer(requests), key, columns, scaling)


def request_rows(imputed: DataFrame, key: str, columns: list[str], scaling: Standard) -> DataFrame:
    """Imputed requests as one row each (key, split, level, mask, original, imputed), back on the original scale.

    ``original`` and ``imputed`` are structs over the columns, null where a cell was not hidden or not known. Scores per mask
    need no row for each cell.
    """
    asked = lambda j: (F.col("mask").bitwiseAND(F.lit(1 << j)) != 0) & F.get("original", F.lit(j)).isNotNull()
    value = lambda j: F.get("imputed", F.lit(j)) * F.lit(scaling.scale[j]) + F.lit(scaling.mean[j])
    return imputed.select(
        q(key), "split", "level", "mask",
        F.struct(*[F.when(asked(j), F.get("original", F.lit(j))).alias(c) for j, c in enumerate(columns)]).alias("original"),
        F.struct(*[F.when(asked(j), value(j)).alias(c) for j, c in enumerate(columns)]).alias("imputed"))


def result_rows(imputed: DataFrame, key: str, columns: list[str], scaling: Standard) -> DataFrame:
    """Imputed requests as one row per hidden known cell, back on the original scale."""
    bit = lambda j: F.col("mask").bitwiseAND(F.lit(1 << j)) != 0
    cells = F.array(*[
        F.when(bit(j) & F.get("original", F.lit(j)).isNotNull(), F.struct(
            F.lit(c).alias("feature"), F.get("original", F.lit(j)).alias("original"),
            (F.get("imputed", F.lit(j)) * F.lit(scaling.scale[j]) + F.lit(scaling.mean[j])).alias("imputed")))
        for j, c in enumerate(columns)])
    # No lambda here: Spark compiles none, and these run for every mask of every row.
    names = F.concat(*[F.when(bit(j), F.array(F.lit(c))).otherwise(F.array().cast("array<string>")) for j, c in enumerate(columns)])
    return imputed.select(q(key), "split", "level", names.alias("combination"), F.inline(cells)).where(F.col("feature").isNotNull())
