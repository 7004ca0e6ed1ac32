"""Near-duplicates by the similarity of their word shingles: candidates by MinHash bands, each confirmed by its exact value.

Texts become sets of word shingles, and equal sets are one node. Nodes that agree in all numbers of a band of their MinHash
signature meet in a bucket. A link is a pair from a bucket whose sets are similar enough, counted exactly. In small buckets
all pairs are counted; in others every node is compared with one of them first, and then with the nodes that this left in
other components, until all pairs not yet known to be in one component are counted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed
from .components import components
from .simhash import _bits, first_of_each
from .texts import sliced, utf8

WIDTH = 5
SIMILAR = 0.8
#: At similarity 0.8 a pair meets in one of the bands with probability 1 - (1 - 0.8 ** 4) ** 20 = 0.99997.
BANDS = 20
BAND_ROWS = 4
#: Buckets of at most so many nodes are compared in all pairs at once.
ALL_PAIRS = 8
#: Centres of a large bucket in the round after its first one, and by how much there are more in each later round.
CENTRES = 128
CENTRES_GROW = 32
#: Rows of a bucket that centres visit at once, and increments of the counts of a comparison.
PART_ROWS = 5_000
WORK = 1 << 22
SLICE = 1 << 20


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of one text as rising hashes; a text of fewer words is one shingle."""
    return np.unique(_bits(text, width))


def _sets(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    data, offsets = utf8(batch.column("text"))
    return [shingles(data[a:b].tobytes(), width) for a, b in zip(offsets[:-1], offsets[1:])]


def bands(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per run of hashes, a number for each band of its MinHash signature."""
    factors = np.random.default_rng(5).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = hashes ^ hashes >> np.uint64(32)
    found = np.zeros((len(starts), BANDS), np.uint64)
    for i, factor in enumerate(factors):
        least = np.minimum.reduceat(mixed * factor, starts)
        band = found[:, i // BAND_ROWS]
        band += least
        band *= np.uint64(0x9E3779B97F4A7C15)
        band ^= band >> np.uint64(29)
    return found


def _sketched(rows: DataFrame, width: int) -> DataFrame:
    """(key, row, node, n, bands): the digest and size of each text's set, and its bands; none for a text without a word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            sets = _sets(batch, width)
            sizes = np.array([len(s) for s in sets])
            full = sizes > 0
            found = np.zeros((0, BANDS), np.uint64)
            if full.any():
                found = bands(np.concatenate(sets), (np.cumsum(sizes) - sizes)[full])
            ends = np.cumsum(np.concatenate(([0], full * BANDS)), dtype=np.int32)
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("row"), pa.array(nodes.view(np.int64)), pa.array(sizes.astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel().view(np.int64)))],
                names=["key", "row", "node", "n", "bands"])

    key = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {key}, row long, node long, n int, bands array<long>")


def _with_sets(rows: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            sets = _sets(batch, width)
            ends = np.cumsum([0, *(len(s) for s in sets)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))],
                names=["row", "grams"])

    return rows.mapInArrow(run, "row long, grams array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (u, v) of rows whose sets are similar enough, by the sets themselves."""
    both = pairs.join(sets.select(F.col("row").alias("v"), F.col("grams").alias("b")), "v").join(
        sets.select(F.col("row").alias("u"), F.col("grams").alias("a")), "u")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared >= F.lit(similar) * (F.size("a") + F.size("b") - shared)).select("u", "v")


def overlaps(grams: np.ndarray, sizes: np.ndarray, centres: np.ndarray, owner: np.ndarray, n_centres: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first member, common shingles of members x centres), some members at a time; ``centres`` are rising hashes with their owners."""
    low, high = (np.searchsorted(centres, grams, side=side) for side in ("left", "right"))
    times, ends = high - low, np.cumsum(sizes)
    work = np.concatenate(([0], np.cumsum(times)))[np.concatenate(([0], ends))] + np.arange(len(sizes) + 1) * n_centres
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(work, work[at] + WORK, side="right")) - 1)
        part = slice(int(ends[at] - sizes[at]), int(ends[end - 1]))
        member = np.repeat(np.arange(end - at), sizes[at:end])
        inside = np.arange(times[part].sum()) - np.repeat(np.cumsum(times[part]) - times[part], times[part])
        met = np.repeat(member, times[part]) * n_centres + owner[np.repeat(low[part], times[part]) + inside]
        yield at, np.bincount(met, minlength=(end - at) * n_centres).reshape(end - at, n_centres)
        at = end


def _near_centres(chosen: DataFrame, state: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (u, v) of a centre and another row of its bucket in another component whose sets are similar enough.

    Rows of a bucket are dealt to parts of about ``PART_ROWS``, each of which all its centres visit; pairs are counted
    there and only links leave the task.
    """
    parts = state.join(chosen.select("bucket").distinct(), "bucket").groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(PART_ROWS)).cast("int").alias("parts"))
    centres = chosen.join(parts, "bucket").select("bucket", "row", "root", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    others = state.join(parts, "bucket").select("bucket", "row", "root", F.lit(1).alias("kind"), F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"))
    dealt = centres.unionByName(others).join(sets, "row").repartition("bucket", "part").sortWithinPartitions("bucket", "part", "kind")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, block = None, [], None
        for batch in batches:
            names = np.column_stack([batch.column("bucket").to_numpy(), batch.column("part").to_numpy(), batch.column("kind").to_numpy()])
            cuts = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]).any(axis=1)))).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(names)]):
                if group is None or (names[a, :2] != group).any():
                    group, held, block = names[a, :2], [], None
                piece = batch.slice(a, b - a)
                rows, roots, grams = piece.column("row").to_numpy(), piece.column("root").to_numpy(), piece.column("grams")
                sizes, flat = grams.value_lengths().to_numpy().astype(np.int64), grams.flatten().to_numpy().view(np.uint64)
                if names[a, 2] == 0:
                    held.append((rows, roots, sizes, flat))
                    continue
                if block is None and held:
                    c_rows, c_roots, c_sizes, c_flat = (np.concatenate(x) for x in zip(*held))
                    order = np.argsort(c_flat, kind="stable")
                    block = c_rows, c_roots, c_sizes, c_flat[order], np.repeat(np.arange(len(c_rows)), c_sizes)[order]
                if block is None:
                    continue
                c_rows, c_roots, c_sizes, hashes, owner = block
                for at, shared in overlaps(flat, sizes, hashes, owner, len(c_rows)):
                    mine = slice(at, at + len(shared))
                    whole = sizes[mine][:, None] + c_sizes[None, :] - shared
                    i, j = np.nonzero((shared >= similar * whole) & (roots[mine][:, None] != c_roots[None, :]))
                    if len(i):
                        pair = np.sort(np.column_stack([rows[mine][i], c_rows[j]]), axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def links(nodes: DataFrame, rows: DataFrame, width: int = WIDTH, similar: float = SIMILAR, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """(node, root) of rows in ``nodes`` (row, n, bands) that links join as all similar pairs of the buckets do.

    A row of a large bucket is compared with all others of other components once it is a centre. A bucket is settled when
    every row outside its largest component was one, so no pair of two components is left out. There is one centre
    while most rows are joined by it, and their number grows from round to round. The sets of the rows that meet any
    other are written once for all rounds, and a round's links are added to the components of the one before.
    """
    placed = nodes.select("row", "n", F.posexplode("bands").alias("band", "value")).select(
        F.xxhash64("band", "value").alias("bucket"), "row", "n")
    crowded = placed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = checkpointed(placed.join(crowded, "bucket"), "buckets")
    compared = checkpointed(members.select("row").distinct(), "compared")
    sets = checkpointed(_with_sets(rows.select("row", "text").join(compared, "row", "left_semi"), width).dropDuplicates(["row"]), "sets")
    # The text that others were copied from meets most of them, so it is the first centre of its buckets.
    central = members.groupBy("row").agg(F.sum("size").alias("met"))
    large = checkpointed(members.where(F.col("size") > all_pairs).select("bucket", "row", "n").join(central, "row"), "large-buckets")
    first = large.groupBy("bucket").agg(F.max(F.struct("met", "row", "n")).alias("c")).select("bucket", "c.row", "c.n")
    first = checkpointed(first, "first-centres")
    small = members.where(F.col("size") <= all_pairs).select("bucket", "row", "n")
    centre = small.unionByName(first).select("bucket", F.col("row").alias("u"), F.col("n").alias("m"))
    done = first.select("bucket", "row")
    large = large.drop("met")
    joined, number = None, CENTRES
    met = centre.join(members.select("bucket", "row", "n"), "bucket").where("u <> row")
    met = met.where(F.least("m", "n") >= F.lit(similar) * F.greatest("m", "n"))  # others cannot be similar enough
    pairs = checkpointed(met.select(F.least("u", "row").alias("u"), F.greatest("u", "row").alias("v")).distinct(), "pairs")
    new = _confirmed(pairs, sets, similar)
    while True:
        joined = components(new if joined is None else new.unionByName(joined.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))))
        state = large.join(joined.select(F.col("node").alias("row"), "root"), "row", "left").withColumn("root", F.coalesce("root", "row"))
        state = checkpointed(state, "state")
        main = state.groupBy("bucket", "root").count().groupBy("bucket").agg(
            F.count("*").alias("roots"), F.max(F.struct("count", "root"))["root"].alias("main")).where("roots > 1").select("bucket", "main")
        left = checkpointed(state.join(main, "bucket").where("root <> main").join(done, ["bucket", "row"], "left_anti"), "apart")
        if left.isEmpty():
            return joined
        apart = left.groupBy("bucket").agg(F.count("*").alias("left"), F.min("row").alias("first"))
        drawn = F.pmod(F.xxhash64("row", "bucket", F.lit(number)), F.lit(1 << 20)) * F.col("left") < F.lit(number << 20)
        chosen = checkpointed(left.join(apart, "bucket").where(drawn | (F.col("row") == F.col("first"))).select("bucket", "row", "n", "root"), "centres")
        done = done.unionByName(chosen.select("bucket", "row"))
        new = _near_centres(chosen, state, sets, similar)
        number *= CENTRES_GROW


def with_groups(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, similar: float = SIMILAR,
                all_pairs: int = ALL_PAIRS) -> DataFrame:
    """One row (key, row, component) for each row of ``df``; texts joined by a chain of similar ones share a component.

    Similarity is that of the sets of ``width``-word shingles: their common part over all of both. ``row`` is a digest of
    key and text. Texts without a word, null ones included, are one group.
    """
    rows = df.select(F.col(key).alias("key"), F.xxhash64(key, text).alias("row"), F.col(text).alias("text"))
    sketched = checkpointed(_sketched(rows, width), "sketches")
    first = checkpointed(sketched.groupBy("node").agg(F.min("row").alias("row"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")), "nodes")
    joined = links(first.select("row", "n", "bands"), rows, width, similar, all_pairs)
    found = first.select("node", "row").join(joined.select(F.col("node").alias("row"), "root"), "row", "left").select(
        "node", F.coalesce("root", "row").alias("component"))
    # Written out, so that the join below has two plain shuffles and a text of very many copies is split.
    return sketched.select("key", "row", "node").join(checkpointed(found, "groups"), "node").select(F.col("key").alias(key), "row", "component")


def near_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``df`` with one row left of each group of near duplicates, the one with the smallest key.

    A null key comes last; between equal keys a digest of the text decides, and of identical rows one stays.
    """
    return first_of_each(df, with_groups(df, text, key, width, similar), text, key)
