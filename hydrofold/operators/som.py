"""Self-organizing map: batch and online training, assignment, and quality measures.

A batch pass is one job: each task finds the best cell of its rows and adds them up per cell; at most
``x * y`` partial sums leave a task. The codebook (cells x features) lives on the driver.

Online training moves the map row by row. Rows are dealt by a digest of their key to shards of a fixed size, and a
digest also says when a row is visited. A round is one job: every shard starts from the round's codebook, makes its
steps in the order of their times, and returns each cell's weights with the mass of all pulls on it; the next codebook
is the mean by mass. Sums are decimals, so the map depends on rows, keys and seed, not on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..schema import q
from .features import pca

# fixed values: map size, neighbourhood width and number of passes
GRID = (4, 4)
SIGMA = 2.0
EPOCHS = 20
# fixed values: learning rate and least number of steps of online training
RATE = 0.9
STEPS = 100_000
#: Online rows of a shard, rounds of a training, and what rate and width fall to.
SHARD_ROWS = 8192
ROUNDS = 20
LAST_RATE = 0.01
LAST_SIGMA = 1.0 / 3.0
#: Distances that are held at once, which stay in a core's cache.
DISTANCES_AT_ONCE = 65_536
#: Products that differ by less, by the size of the numbers, are told apart by the plain distances.
CLOSE = 1e-12


@dataclass(frozen=True)
class Codebook:
    """Weights of an x by y hexagonal map, cell ``cx * y + cy`` in row order."""

    columns: tuple[str, ...]
    x: int
    y: int
    weights: np.ndarray

    def positions(self) -> np.ndarray:
        """Plane coordinates: odd rows shifted by half a cell, rows a hexagon apart."""
        cx, cy = np.divmod(np.arange(self.x * self.y), self.y)
        return np.column_stack([cx + 0.5 * (cy % 2), cy * np.sqrt(3) / 2])

    def neighbours(self) -> np.ndarray:
        """Cells x cells matrix, true where two cells touch."""
        p = self.positions()
        return np.isclose(np.linalg.norm(p[:, None] - p[None], axis=2), 1.0)


def grid_codebook(columns: list[str], x: int, y: int) -> Codebook:
    """A codebook on the unit cube's plane: even features follow x, odd ones y."""
    cx, cy = np.divmod(np.arange(x * y), y)
    sides = (cx / max(x - 1, 1), cy / max(y - 1, 1))
    return Codebook(tuple(columns), x, y, np.column_stack([sides[j % 2] for j in range(len(columns))]))


def plane_codebook(df: DataFrame, columns: list[str], x: int, y: int) -> Codebook:
    """Initial codebook on the plane of the two leading components, one deviation to each side."""
    c = pca(df, columns, 2)
    cx, cy = np.divmod(np.arange(x * y), y)
    u = cx / (x - 1) * 2 - 1 if x > 1 else np.zeros(x * y)
    v = cy / (y - 1) * 2 - 1 if y > 1 else np.zeros(x * y)
    spread = np.sqrt(c.variances)[:, None] * c.directions
    return Codebook(tuple(columns), x, y, c.mean + np.outer(u, spread[0]) + np.outer(v, spread[1] if len(spread) > 1 else 0 * spread[0]))


def _distances(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Squared distances rows x cells; differences are squared feature by feature, so equal rows get equal values."""
    out = np.zeros((len(rows), len(weights)))
    for j in range(rows.shape[1]):
        out += (rows[:, j, None] - weights[None, :, j]) ** 2
    return out


def _best_cells(x: np.ndarray, weights: np.ndarray, second: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The cell of least distance of each row of ``x`` (features x rows), and if asked for the next one; ties take the first cell.

    Products x.w - |w|^2 / 2 find the cell; rows where another cell comes within rounding are decided by ``_distances``.
    """
    cells, n = len(weights), x.shape[1]
    numbers = np.arange(cells, dtype=np.uint8 if cells <= 256 else np.int64)[:, None]
    half = 0.5 * (weights * weights).sum(axis=1)
    found = np.zeros((1 + second, n), np.int64)
    step = max(64, DISTANCES_AT_ONCE // cells)
    for at in range(0, n, step):
        part = x[:, at:at + step]
        with np.errstate(invalid="ignore", over="ignore"):
            score = weights @ part
            score -= half[:, None]
            room = CLOSE * (1.0 + (part * part).sum(axis=0) + 2.0 * half.max())
            unsure = np.zeros(part.shape[1], bool)
            for one in found[:, at:at + step]:
                near = score > score.max(axis=0) - room
                unsure |= near.sum(axis=0, dtype=np.uint8 if cells < 256 else np.int64) != 1
                one[:] = np.where(unsure, 0, (near.view(np.uint8) * numbers).sum(axis=0, dtype=numbers.dtype))
                if second:
                    score[one, np.arange(len(one))] = -np.inf
        rows = np.flatnonzero(unsure)
        for some in np.split(rows, range(step, len(rows), step)) if len(rows) else ():
            d = _distances(part[:, some].T, weights)
            for one in found[:, at:at + step]:
                one[some] = d.argmin(axis=1)
                d[np.arange(len(some)), one[some]] = np.inf
    return found[0], found[1] if second else None


def _cell_sums(df: DataFrame, books: list[Codebook]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every codebook, per cell the sum of its rows and their number, all in one pass."""
    columns, d = books[0].columns, len(books[0].columns)
    weights = [book.weights for book in books]
    names = [f"s{j}" for j in range(d)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(w), d + 1)) for w in weights]
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            for w, total in zip(weights, sums):
                best, _ = _best_cells(rows, w)
                for j in range(d):
                    total[:, j] += np.bincount(best, rows[j], len(w))
                total[:, d] += np.bincount(best, minlength=len(w))
        for i, total in enumerate(sums):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), i, np.int32)), pa.array(np.arange(len(total), dtype=np.int32)),
                                              *map(pa.array, total.T.copy())], names=["book", "cell", *names, "n"])

    schema = "book int, cell int, " + ", ".join(f"{s} double" for s in [*names, "n"])
    partials = df.select([q(c).cast("double") for c in columns]).mapInArrow(partial, schema)
    totals = partials.groupBy("book", "cell").agg(*[F.sum(s).alias(s) for s in [*names, "n"]]).toPandas().sort_values(["book", "cell"])  # all cells
    if not totals["n"].sum():
        raise ValueError("no rows to train on")
    found = [totals[totals["book"] == i] for i in range(len(books))]
    return [(t[names].to_numpy(), t["n"].to_numpy()) for t in found]


def som_fit_sizes(df: DataFrame, columns: list[str], sizes: list[tuple[int, int]], sigma: float = SIGMA, epochs: int = EPOCHS,
                  start: list[Codebook] | None = None) -> list[Codebook]:
    """Batch training of maps of several sizes on complete rows, which should be scaled and persisted; a pass serves all.

    Each pass moves every cell to the mean of all rows weighted by the Gaussian of the grid distance between
    their best cell and it; the width falls from ``sigma`` to a third of a cell. The result depends on the
    data only, not on an order or a seed.
    """
    complete = df.dropna("any", subset=columns)
    books = start or [plane_codebook(complete, columns, x, y) for x, y in sizes]
    grids = [((p[:, None] - p[None]) ** 2).sum(axis=2) for p in (book.positions() for book in books)]
    for epoch in range(epochs):
        width = sigma * (1.0 / (3.0 * sigma)) ** (epoch / max(epochs - 1, 1))
        moved = []
        for book, grid, (sums, counts) in zip(books, grids, _cell_sums(complete, books)):
            influence = np.exp(-grid / (2 * width * width))
            mass = influence @ counts
            weights = np.where(mass[:, None] > 1e-12, influence @ sums / np.maximum(mass, 1e-12)[:, None], book.weights)
            moved.append(Codebook(book.columns, book.x, book.y, weights))
        books = moved
    return books


def som_fit(df: DataFrame, columns: list[str], x: int = GRID[0], y: int = GRID[1], sigma: float = SIGMA,
            epochs: int = EPOCHS, start: Codebook | None = None) -> Codebook:
    """The map of one size."""
    return som_fit_sizes(df, columns, [(x, y)], sigma, epochs, [start] if start else None)[0]


@dataclass(frozen=True)
class Decay:
    """Learning rate and width as functions of the share of training that is done: geometric from first to last value."""

    rate: float = RATE
    sigma: float = SIGMA
    last_rate: float = LAST_RATE
    last_sigma: float = LAST_SIGMA

    def at(self, done: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.rate * (self.last_rate / self.rate) ** done, self.sigma * (self.last_sigma / self.sigma) ** done


def online_steps(weights: np.ndarray, rows: np.ndarray, grid: np.ndarray, rate: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights after pulling the map to one row after another, and the mass of all pulls on each cell."""
    weights, mass = weights.copy(), np.zeros(len(weights))
    spread = -0.5 / sigma ** 2
    for x, a, width in zip(rows, rate, spread):
        gap = x - weights
        pull = a * np.exp(width * grid[(gap * gap).sum(axis=1).argmin()])
        weights += pull[:, None] * gap
        mass += pull
    return weights, mass


def online_visits(df: DataFrame, key: str, columns: list[str], passes: int, shards: int, seed: int) -> DataFrame:
    """(shard, time, x): each complete row once in every pass, at a time and in a shard that digests of its key name."""
    part = lambda text: F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    name = q(key).cast("string")
    times = F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), lambda p: p + part(F.concat(F.lit(f"{seed}:"), p.cast("string"), F.lit(":"), name)) / F.lit(float(1 << 52)))
    return df.dropna("any", subset=columns).select(
        F.pmod(part(F.concat(F.lit(f"{seed}:"), F.coalesce(name, F.lit("")))), F.lit(shards)).alias("shard"),
        F.explode(times).alias("time"), F.array(*[q(c).cast("double") for c in columns]).alias("x"))


def online_round(visits: DataFrame, book: Codebook, start: float, end: float, passes: int, decay: Decay = Decay()) -> Codebook:
    """The codebook after the visits in [start, end): each shard's own steps, averaged by the mass of their pulls.

    A cell that no row has pulled stays where it is.
    """
    p = book.positions()
    grid, d = ((p[:, None] - p[None]) ** 2).sum(axis=2), len(book.columns)
    names = [f"s{j}" for j in range(d)]

    def steps(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rows, time = table.column("x").chunk(0).flatten().to_numpy().reshape(-1, d), table.column("time").to_numpy()
        order = np.lexsort((*rows.T[::-1], time))  # equal times: by value
        weights, mass = online_steps(book.weights, rows[order], grid, *decay.at(time[order] / passes))
        return pa.table({"cell": pa.array(np.arange(len(mass), dtype=np.int32)), **{n: mass * weights[:, j] for j, n in enumerate(names)}, "mass": mass})

    schema = "cell int, " + ", ".join(f"{n} double" for n in [*names, "mass"])
    moved = visits.where((F.col("time") >= start) & (F.col("time") < end)).groupBy("shard").applyInArrow(steps, schema)
    exact = [F.sum(F.col(n).cast("decimal(38,18)")).cast("double").alias(n) for n in [*names, "mass"]]
    found = moved.groupBy("cell").agg(*exact).toPandas().sort_values("cell")  # a row for each cell
    if found.empty:
        return book
    mass = found["mass"].to_numpy()[:, None]
    weights = np.where(mass > 1e-12, found[names].to_numpy() / np.maximum(mass, 1e-12), book.weights)
    return Codebook(book.columns, book.x, book.y, weights)


def som_fit_online(df: DataFrame, key: str, columns: list[str], x: int = GRID[0], y: int = GRID[1], decay: Decay = Decay(),
                   steps: int = STEPS, rounds: int = ROUNDS, seed: int = 42, shard_rows: int = SHARD_ROWS, start: Codebook | None = None) -> Codebook:
    """Online training on complete rows, which should be scaled: every row is visited equally often, in at least ``steps``
    visits altogether and at least once.

    A table of up to ``shard_rows`` rows is trained row by row in one sequence; larger ones in as many sequences as
    there are shards, joined after each of ``rounds`` rounds. Rows that share a key are visited at the same times, in
    the order of their values; null keys are one key.
    """
    complete = df.select(key, *[q(c) for c in columns]).dropna("any", subset=columns)
    rows = complete.count()
    if not rows:
        raise ValueError("no rows to train on")
    book = start or plane_codebook(complete, columns, x, y)
    passes, shards = -(-steps // rows) if steps > rows else 1, -(-rows // shard_rows)
    visits = online_visits(complete.withColumn(key, F.coalesce(q(key).cast("string"), F.lit(""))), key, columns, passes, shards, seed)
    visits = visits.repartition(shards, "shard").persist()
    try:
        for number in range(rounds):
            book = online_round(visits, book, passes * number / rounds, passes * (number + 1) / rounds, passes, decay)
    finally:
        visits.unpersist()
    return book


def som_assign(df: DataFrame, book: Codebook) -> DataFrame:
    """Add som_x, som_y, distance to the best cell, and whether the second best touches it; ties take the first cell."""
    weights, height, touching = book.weights, book.y, book.neighbours()
    schema = T.StructType([T.StructField("som_x", T.IntegerType()), T.StructField("som_y", T.IntegerType()),
                           T.StructField("distance", T.DoubleType()), T.StructField("second_touches", T.BooleanType())])

    @F.pandas_udf(schema)
    def best(columns: pd.DataFrame) -> pd.DataFrame:
        rows = np.stack([columns[c].to_numpy(dtype=float) for c in columns])
        first, second = _best_cells(rows, weights, second=True)
        distance = np.sqrt(sum((x - w[first]) ** 2 for x, w in zip(rows, weights.T)))
        return pd.DataFrame({"som_x": (first // height).astype("int32"), "som_y": (first % height).astype("int32"),
                             "distance": distance, "second_touches": touching[first, second]})

    complete = df.dropna("any", subset=list(book.columns))
    return complete.withColumn("_bmu", best(F.struct(*[q(c).cast("double").alias(f"f{i}") for i, c in enumerate(book.columns)]))).select(
        "*", "_bmu.*").drop("_bmu")


def som_quality(assigned: DataFrame) -> DataFrame:
    """Quantization error (mean distance) and topographic error (share whose two best cells do not touch)."""
    return assigned.agg(
        F.count("*").alias("n"), F.avg("distance").alias("quantization_error"),
        F.avg((~F.col("second_touches")).cast("double")).alias("topographic_error"))


def errors_by_size(errors: DataFrame) -> DataFrame:
    """Mean errors per map size over feature sets."""
    return errors.groupBy("size").agg(
        F.avg("quantization_error").alias("q_mean"), F.avg("topographic_error").alias("t_mean"), F.count("*").alias("runs"))
