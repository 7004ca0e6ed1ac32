"""Hard negatives: rows of another label that score just below an anchor's positives, by exact whole-number scores.

Rows are dealt to blocks and every anchor visits every block, where all scores come from products modulo small primes.
A first round finds the positives, a second one selects the negatives from the window below each positive's score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import q
from ..session import checkpointed
from .residues import Residues

BLOCK_ROWS = 20_000
ANCHORS_AT_ONCE = 128
#: Fewer rows than this are not worth a task.
LEAST_ROWS = 1_000


def whole(df: DataFrame, is_anchor: Column, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, vector, is_anchor) of the rows that take part, components as floor(scale * x)."""
    exact = F.transform(q(vector), lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(q(key).cast("long").alias("id"), q(label).cast("long").alias("label"), exact.alias("vector"),
                     F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0)).where(finite)
    return rows.withColumn("vector", F.transform("vector", lambda x: _floor(x * float(scale))))


def _floor(x: Column) -> Column:
    """Round down and stay a double, which whole numbers above 64 bits do too; those are already whole."""
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


def _ranked(scores: np.ndarray, mask: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest masked scores of each row, the smaller column first among equals."""
    least = np.iinfo(np.int64).min
    scores = np.where(mask, scores, least)
    k = min(k, scores.shape[1])
    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    row, column = np.nonzero((scores >= edge[:, None]) & mask)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _windows(scores: np.ndarray, mask: np.ndarray, tops: list[np.ndarray], low: int, high: int, k: int):
    """(row, which of its tops, column) of the first k masked scores in [low / high * top, top] of each top.

    The windows of a row are cut out of its scores at once and sorted; each window is then a run.
    """
    floors = [-(-low * t // high) for t in tops]
    some = np.array([len(t) > 0 for t in tops])
    bottom = np.array([f.min() if len(f) else 0 for f in floors])
    top = np.array([t.max() if len(t) else -1 for t in tops])
    row, column = np.nonzero(mask & some[:, None] & (scores >= bottom[:, None]) & (scores <= top[:, None]))
    score = scores[row, column]
    order = np.lexsort((column, -score, row))
    row, column, score = row[order], column[order], score[order]
    ends = np.searchsorted(row, np.arange(len(tops) + 1))
    found: list[tuple[int, int, np.ndarray]] = []
    for i in np.flatnonzero(np.diff(ends)):
        mine = -score[ends[i]:ends[i + 1]]
        for j, (t, f) in enumerate(zip(tops[i], floors[i])):
            start = np.searchsorted(mine, -t)
            end = min(start + k, np.searchsorted(mine, -f, side="right"))
            if start < end:
                found.append((int(i), j, column[ends[i] + start:ends[i] + end]))
    return found


def _blocks(batches: Iterable[pa.RecordBatch], system: Residues) -> Iterator[tuple]:
    """(anchors, block): rows sorted by (part, anchor) as batches of anchors next to the block they visit, rows by id."""
    part, held, block = None, [], None
    for batch in batches:
        parts, asks = batch.column("part").to_numpy(), batch.column("is_anchor").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.concatenate(([True], (parts[1:] != parts[:-1]) | (asks[1:] != asks[:-1])))).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(parts)]):
            if parts[a] != part:
                part, held, block = parts[a], [], None
            piece = batch.slice(a, b - a)
            if not asks[a]:
                held.append(piece)
                continue
            if block is None and held:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
                order = np.argsort(ids, kind="stable")
                block = ids[order], labels[order], system.split(_numbers(rows)[order])
                held = []
            for at in range(0, piece.num_rows if block else 0, ANCHORS_AT_ONCE):
                some = piece.slice(at, ANCHORS_AT_ONCE)
                yield some, block, system.products(system.split(_numbers(some)), block[2])


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def mine(df: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256,
         positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive.

    Components become floor(scale * x), a score is the whole-number inner product, larger scores come first and ties go
    to the smaller key. An anchor's positives are the first ``positives`` rows of its label with another key; a
    positive's negatives are the first ``negatives`` rows of other labels with
    low * positive_score <= high * negative_score <= high * positive_score; a negative positive score has none.
    Rows with a null key, label, vector or component, a non-finite component or no component take no part, nor do
    vectors of other than the most common length. A repeated row counts as often as it is there, as an anchor too. An
    empty table gives no row. Scores that may not fit 64 bits raise ValueError.
    """
    spark = df.sparkSession
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    valid = whole(df, is_anchor, key, vector, label, scale)
    largest = F.array_max(F.transform("vector", F.abs))
    sizes = valid.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.max(largest).alias("most")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return empty
    if sizes["most"] >= float(1 << 31):
        raise ValueError(f"components of up to {sizes['most']} have inner products that may not fit 64 bits")
    system = Residues(sizes["d"], sizes["d"] * int(sizes["most"]) ** 2)
    cores = spark.sparkContext.defaultParallelism
    parts = max(-(-sizes["n"] // block_rows), min(cores, -(-sizes["n"] // LEAST_ROWS)))
    numbered = valid.where(F.size("vector") == sizes["d"]).withColumns({
        "vector": F.transform("vector", lambda x: x.cast("long")), "row": F.monotonically_increasing_id()})
    rows = checkpointed(numbered.withColumn("part", F.pmod("row", F.lit(parts)).cast("int")), "scored-rows")
    anchors = rows.where("is_anchor").select(F.col("row").alias("anchor"), "id", "label", "vector")

    def visits(anchors: DataFrame, output: str, run: Callable) -> DataFrame:
        blocks = rows.select("part", F.lit(False).alias("is_anchor"), "id", "label", "vector")
        asks = anchors.withColumns({"part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "is_anchor": F.lit(True)})
        dealt = blocks.unionByName(asks, allowMissingColumns=True).repartition(parts, "part").sortWithinPartitions("part", "is_anchor")
        return dealt.mapInArrow(lambda batches: run(_blocks(batches, system)), output)

    def first_round(visited) -> Iterator[pa.RecordBatch]:
        for some, (ids, labels, _), scores in visited:
            mine_, own = some.column("label").to_numpy(), some.column("id").to_numpy()
            row, column = _ranked(scores, (mine_[:, None] == labels[None, :]) & (own[:, None] != ids[None, :]), positives)
            yield pa.RecordBatch.from_arrays([some.column("anchor").take(pa.array(row)), pa.array(ids[column]), pa.array(scores[row, column])],
                                             names=["anchor", "positive_id", "score"])

    found = visits(anchors, "anchor long, positive_id long, score long", first_round)
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id")
    tops = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives).groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("place", "positive_id", "score"))).alias("found"))
    asking = checkpointed(anchors.join(tops, "anchor").select("anchor", "id", "label", "vector", F.col("found.positive_id").alias("positive_ids"),
                                                              F.col("found.score").alias("tops")), "anchors")

    def second_round(visited) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "anchor_id", "place", "positive_id", "negative_id", "positive_score", "negative_score"]
        for some, (ids, labels, _), scores in visited:
            at, anchor = some.column("label").to_numpy(), some.column("anchor").to_numpy()
            own, theirs = some.column("id").to_numpy(), some.column("positive_ids").to_pylist()
            limits = [np.array(t, np.int64) for t in some.column("tops").to_pylist()]
            hits = _windows(scores, at[:, None] != labels[None, :], limits, low, high, negatives)
            if not hits:
                continue
            sizes_ = np.array([len(c) for _, _, c in hits])
            i, j = (np.repeat(np.array([h[n] for h in hits]), sizes_) for n in (0, 1))
            column = np.concatenate([c for _, _, c in hits])
            arrays = [anchor[i], own[i], j.astype(np.int32), np.array([theirs[a][b] for a, b in zip(i, j)], np.int64), ids[column],
                      np.array([limits[a][b] for a, b in zip(i, j)], np.int64), scores[i, column]]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)

    hard = visits(asking, "anchor long, anchor_id long, place int, positive_id long, negative_id long, positive_score long, negative_score long", second_round)
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    return hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(empty.columns)
