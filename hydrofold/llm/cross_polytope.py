"""Approximate nearest neighbours by cross-polytope hashing, with the largest inner product as nearness.

Vectors are scaled into the unit ball and lifted onto the sphere by one more coordinate, which turns inner products into
cosines. Fast pseudo-rotations (random signs and Hadamard transforms) spread them, and the nearest signed axis is the
bucket. A query looks into the buckets of its nearest axes in every table, and the rows it finds are ranked by their
exact inner product with it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpointed

TABLES = 8
PROBES = 32
BLOCK_ROWS = 20_000
HELD_QUERIES = 50_000
QUERIES_AT_ONCE = 256


class Hasher:
    """The tables' rotations for vectors of one dimension."""

    def __init__(self, dimension: int, largest: float, tables: int, seed: int):
        self.dimension, self.largest, self.tables = dimension, largest, tables
        self.width = 1 << dimension.bit_length()  # holds the vector and the lifted coordinate
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.width))

    @property
    def axes(self) -> int:
        return 2 * self.width

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        """Indexed vectors on the unit sphere."""
        unit = np.zeros((len(rows), self.width))
        unit[:, :self.dimension] = rows / self.largest
        unit[:, self.dimension] = np.sqrt(np.maximum(0, 1 - (unit ** 2).sum(axis=1)))
        return unit

    def directions(self, rows: np.ndarray) -> np.ndarray:
        """Query vectors on the unit sphere; their lifted coordinate is zero."""
        unit = np.zeros((len(rows), self.width))
        unit[:, :self.dimension] = rows / np.linalg.norm(rows, axis=1, keepdims=True)
        return unit

    def rotated(self, unit: np.ndarray, table: int) -> np.ndarray:
        for signs in self.signs[table]:
            unit = unit * signs
            step = 1
            while step < self.width:
                halves = unit.reshape(len(unit), -1, 2, step)
                unit = np.stack((halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]), axis=2).reshape(len(unit), self.width)
                step *= 2
            unit /= np.sqrt(self.width)
        return unit

    def bucket(self, unit: np.ndarray, table: int) -> np.ndarray:
        turned = self.rotated(unit, table)
        axis = np.abs(turned).argmax(axis=1)
        return 2 * axis + (turned[np.arange(len(turned)), axis] > 0)

    def probes(self, unit: np.ndarray, table: int, number: int) -> np.ndarray:
        """The buckets of the nearest signed axes, nearest first."""
        turned = self.rotated(unit, table)
        both = np.stack((-turned, turned), axis=2).reshape(len(turned), self.axes)
        return np.argsort(-both, axis=1, kind="stable")[:, :number]


def _matrix(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _lists(values: np.ndarray) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


class _Best:
    """The ``k`` nearest found so far of the queries met in a task."""

    def __init__(self, k: int):
        self.k = k
        self.rows = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query, vector, score
        self.waiting: list[list[np.ndarray]] = []

    def add(self, query: np.ndarray, vector: np.ndarray, score: np.ndarray) -> None:
        self.waiting.append([query, vector, score])
        if sum(len(w[0]) for w in self.waiting) > max(200_000, len(self.rows[0])):
            self.settle()

    def settle(self) -> None:
        query, vector, score = (np.concatenate(c) for c in zip(self.rows, *self.waiting))
        self.waiting = []
        order = np.lexsort((vector, -score, query))
        query, vector, score = query[order], vector[order], score[order]
        new = np.ones(len(query), bool)  # one vector can be met in several tables
        new[1:] = (query[1:] != query[:-1]) | (vector[1:] != vector[:-1])
        query, vector, score = query[new], vector[new], score[new]
        first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        self.rows = [c[rank < self.k] for c in (query, vector, score)]

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        for at in range(0, len(self.rows[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at:at + 100_000]) for c in self.rows], names=["query_id", "vec_id", "score"])
        self.rows = [c[:0] for c in self.rows]


def _compare(best: _Best, queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
    """The nearest rows of one block for each query of its bucket.

    Of equal vectors only the smallest ids can be among the nearest. Products are first formed for the whole block; the
    best ones and all within rounding of them are formed again one by one, so that equal vectors score the same.
    """
    order = np.argsort(ids, kind="stable")
    _, which = np.unique(rows[order].view(np.uint8).reshape(len(rows), -1).view(f"V{rows.shape[1] * 8}").ravel(), return_inverse=True)
    by = np.argsort(which, kind="stable")
    which = which[by]
    first = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
    rank = np.arange(len(which)) - np.repeat(first, np.diff(np.append(first, len(which))))
    keep = order[by[rank <= best.k]]
    rows, ids = rows[keep], ids[keep]
    slack = 1e-12 * rows.shape[1] * max(1e-300, np.abs(rows).max())
    for at in range(0, len(queries), QUERIES_AT_ONCE):
        q, q_ids = queries[at:at + QUERIES_AT_ONCE], query_ids[at:at + QUERIES_AT_ONCE]
        near = q @ rows.T
        near[q_ids[:, None] == ids[None, :]] = -np.inf
        k = min(best.k, len(ids))
        least = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k]
        mine, other = np.nonzero((near >= (least - slack * np.abs(q).max(axis=1))[:, None]) & (near > -np.inf))
        best.add(q_ids[mine], ids[other], (q[mine] * rows[other]).sum(axis=1))


def _search(batches: Iterable[pa.RecordBatch], k: int, dimension: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (slot, part, is_query): the vectors of a block, then the queries that look into it."""
    best, block, held, met = _Best(k), None, [], 0
    for batch in batches:
        slot = batch.column("slot").to_numpy().astype(np.int64) << 32 | batch.column("part").to_numpy()
        asks = batch.column("is_query").to_numpy(zero_copy_only=False)
        ids, vectors = batch.column("id").to_numpy(), _matrix(batch, dimension)
        cuts = np.flatnonzero(np.concatenate(([True], (slot[1:] != slot[:-1]) | (asks[1:] != asks[:-1])))).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(slot)]):
            if slot[a] != block:
                block, held = slot[a], []
            if not asks[a]:
                held.append((ids[a:b], vectors[a:b]))
            elif held:
                if len(held) > 1:
                    held = [(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))]
                _compare(best, vectors[a:b], ids[a:b], held[0][1], held[0][0])
                met += b - a
                if met > HELD_QUERIES:
                    yield from best.batches()
                    met = 0
    yield from best.batches()


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector) of the vectors that take part: not null, not zero, without null or non-finite components."""
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (df.select(F.col(key).cast("long").alias("id"), values.alias("vector"))
            .where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(finite)
            .where(F.exists("vector", lambda x: x != 0)))


def nearest(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, tables: int = TABLES,
            probes: int = PROBES, seed: int = 11, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds, the ``k`` other rows found with the largest
    inner product, ties to the smaller key.

    Vectors of other than the most common dimension take no part, as those that are not ``usable``. A bucket is searched
    in blocks of about ``block_rows`` vectors, so one vector that most rows share is many blocks. Queries that find
    fewer than ``k`` rows although there are more look into every bucket of one table, which is exact. Repeated keys are
    one row per vector; an empty table gives no row. Recall is set by ``tables`` and ``probes``.
    """
    spark = df.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    valid = usable(df, key, vector)
    asking = usable(df.where(is_query), key, vector)
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    sizes = valid.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.sqrt(F.max(length)).alias("largest")).orderBy(
        F.desc("n"), "d").first()
    if sizes is None:
        return empty
    hasher = Hasher(sizes["d"], sizes["largest"], tables, seed)
    valid, asking = (x.where(F.size("vector") == sizes["d"]) for x in (valid, asking))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(tables * hasher.axes, np.int64)
        for batch in batches:
            unit = hasher.lifted(_matrix(batch, hasher.dimension))
            for t in range(tables):
                found += np.bincount(t * hasher.axes + hasher.bucket(unit, t), minlength=len(found))
        slots = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(found[slots])], names=["slot", "n"])

    counted = valid.mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # tables x axes rows
    parts = np.ones(tables * hasher.axes, np.int64)
    for row in counted:
        parts[row["slot"]] = -(-row["n"] // block_rows)

    def run(indexed: DataFrame, queries: DataFrame, used: int, looks: int) -> DataFrame:
        schema = "slot int, part int, is_query boolean, id long, vector array<double>"

        def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, rows = batch.column("id").to_numpy(), _matrix(batch, hasher.dimension)
                unit = hasher.lifted(rows)
                mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                for t in range(used):
                    slot = t * hasher.axes + hasher.bucket(unit, t)
                    yield from emit(slot, mixed.astype(np.int64) % parts[slot], False, ids, rows)

        def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, rows = batch.column("id").to_numpy(), _matrix(batch, hasher.dimension)
                unit = hasher.directions(rows)
                for t in range(used):
                    slots = t * hasher.axes + hasher.probes(unit, t, looks)
                    for column in slots.T:
                        times = parts[column]
                        owner = np.repeat(np.arange(len(ids)), times)
                        part = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
                        yield from emit(column[owner], part, True, ids[owner], rows[owner])

        def emit(slot, part, is_query, ids, rows):
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.full(len(ids), is_query)), pa.array(ids), _lists(rows)],
                names=["slot", "part", "is_query", "id", "vector"])

        both = indexed.mapInArrow(index, schema).unionByName(queries.mapInArrow(ask, schema))
        dealt = both.repartition("slot", "part").sortWithinPartitions("slot", "part", "is_query")
        return dealt.mapInArrow(lambda batches: _search(batches, k, hasher.dimension), "query_id long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return once.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = checkpointed(ranked(run(valid, asking, tables, probes)), "nearest")
    enough = first.where(F.col("rank") == min(k, max(1, sizes["n"] - 1))).select(F.col("query_id").alias("id"))
    short = checkpointed(asking.join(enough, "id", "left_anti"), "short-queries")
    if short.isEmpty():
        return first
    rest = ranked(run(valid, short, 1, hasher.axes))
    return first.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)
