"""SimHash near-duplicates: 64-bit fingerprints of word shingles, joined by walking a binary trie in pairs of nodes.

Fingerprints that differ in at most three bits agree in one of four 16-bit blocks. Rotating each block to the front
gives four tries whose top is that block, so pairs of nodes are only ever met below a common top, and the tops are the
keys by which Spark deals out the work. Below it two nodes are walked together: their children are paired, a pair of
different bits costs one error, and a pair beyond the budget is dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpointed
from .components import components
from .texts import fresh, sliced, utf8

BITS = 64
BLOCK = 16
GROUP_ROWS = 30_000
CHUNK_ROWS = 200_000
PAIRS_AT_ONCE = 1 << 21


def fingerprint(text: bytes, width: int = 3) -> int:
    """The SimHash of one UTF-8 text (A-Z lower-cased, words at ASCII white space); zero without a word."""
    bits = _bits(text, width)
    return int(_majority(bits, np.zeros(1, np.int64))[0]) if len(bits) else 0


def _bits(text: bytes, width: int) -> np.ndarray:
    words = text.lower().split()  # on bytes both touch ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    plain = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(plain, 42)], np.uint64)
    return np.array([digest(plain[a:b], 42) for a, b in zip(starts, ends[width - 1:])], np.uint64)


def _majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per run of hashes, the bits that are set in more than half of them.

    Every eighth bit is counted in its own byte of one word, over stretches of at most 255 hashes.
    """
    sizes = np.diff(np.append(starts, len(hashes)))
    stretches = -(-sizes // 255)
    first = np.cumsum(stretches) - stretches
    place = np.arange(stretches.sum()) - np.repeat(first, stretches)
    cuts = np.repeat(starts, stretches) + 255 * place
    sums = np.empty((len(starts), BITS), np.int64)
    lane = np.uint64(0x0101010101010101)
    for bit in range(8):
        counted = np.add.reduceat((hashes >> np.uint64(bit)) & lane, cuts).view(np.uint8).reshape(-1, 8)
        sums[:, bit::8] = np.add.reduceat(counted, first, axis=0, dtype=np.int64)
    return np.packbits(sums * 2 > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def with_fingerprints(df: DataFrame, text: str = "text", output: str = "fingerprint", width: int = 3) -> DataFrame:
    """``df`` plus the fingerprint of ``text`` as a signed long; null and empty texts have fingerprint zero."""
    fields = [f for f in df.schema.fields if f.name != output]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            data, offsets = utf8(batch.column(text))
            found = [_bits(data[a:b].tobytes(), width) for a, b in zip(offsets[:-1], offsets[1:])]
            sizes = np.array([len(x) for x in found])
            values = np.zeros(len(found), np.uint64)
            if sizes.any():
                full = sizes > 0
                starts = np.cumsum(sizes) - sizes
                values[full] = _majority(np.concatenate(found), starts[full])
            columns = [batch.column(f.name) for f in fields] + [pa.array(values.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in fields), output])

    schema = df.select(*(f"`{f.name}`" for f in fields)).schema.add(output, "long")
    return df.mapInArrow(run, schema)


# --- the trie, walked in pairs ---------------------------------------------------------------------------------------


class _Sets:
    """Disjoint sets over 0..n-1 whose root is the smallest member; unions come in batches."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                further = self.root[self.root]
                if np.array_equal(further, self.root):
                    break
                self.root = further


def linked(values: np.ndarray, whole: np.ndarray, starts: np.ndarray, budget: int) -> np.ndarray:
    """The smallest index linked with each of the ``values``, sorted within their tries.

    ``starts`` are the first indices of the tries and ``whole`` the fingerprints of which the values are a part. Node
    pairs are walked for a budget of one error, then two, and so on: subtrees that are one component by then are not
    walked again, which keeps dense clusters from being enumerated pair by pair.
    """
    sets = _Sets(len(values))
    ends = np.append(starts[1:], len(values))
    shared = ends - starts > 1
    depth = int(values.max()).bit_length() if len(values) else 0
    for errors in range(1, budget + 1):
        _walk(values, whole, starts[shared], ends[shared], depth, errors, sets)
    return sets.root


def _walk(values, whole, low, high, depth, budget, sets) -> None:
    """Walk the nodes [low, high), each paired with itself, down ``depth`` bits; split the work where many pairs are alive."""
    stack = [(depth, low, high, low, high, np.zeros(len(low), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        bit, a, a_end, b, b_end, spent = stack.pop()
        if len(a) > PAIRS_AT_ONCE:
            half = len(a) // 2
            for part in (slice(half), slice(half, None)):
                stack.append((bit, a[part], a_end[part], b[part], b_end[part], spent[part]))
            continue
        if not len(a):
            continue
        # Pairs of single fingerprints are decided at once.
        leaf = (a_end - a == 1) & (b_end - b == 1)
        if leaf.any():
            x, y = a[leaf], b[leaf]
            near = (x != y) & (np.bitwise_count(whole[x] ^ whole[y]) <= budget)
            sets.union(x[near], y[near])
            a, a_end, b, b_end, spent = (v[~leaf] for v in (a, a_end, b, b_end, spent))
        # A subtree that is one component already has no link left to add.
        first = sets.root
        change = np.concatenate(([0], np.cumsum(first[1:] != first[:-1])))
        done = (first[a] == first[b]) & (change[a] == change[a_end - 1]) & (change[b] == change[b_end - 1])
        a, a_end, b, b_end, spent = (v[~done] for v in (a, a_end, b, b_end, spent))
        if not len(a) or bit == 0:
            continue
        bit -= 1
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        count = ones[bit]
        a_cut, b_cut = a_end - (count[a_end] - count[a]), b_end - (count[b_end] - count[b])
        same = (a == b) & (a_end == b_end)
        kept = []
        for p, p_end, r, r_end, cost, wanted in (
            (a, a_cut, b, b_cut, spent, True),
            (a_cut, a_end, b_cut, b_end, spent, True),
            (a, a_cut, b_cut, b_end, spent + 1, True),
            (a_cut, a_end, b, b_cut, spent + 1, ~same),  # of a node with itself this is the pair before
        ):
            alive = (p < p_end) & (r < r_end) & (cost <= budget) & wanted
            kept.append(tuple(v[alive] for v in (p, p_end, r, r_end, cost)))
        stack.append((bit, *(np.concatenate(v) for v in zip(*kept))))


def _link_batches(batches: Iterable[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Rows (trie, skip, rest) sorted by (trie, rest) become spanning links (u, v) of the fingerprints, trie by trie."""
    held: list[np.ndarray] = []

    def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        rest, trie = np.ascontiguousarray(rows["rest"]), rows["trie"]
        starts = np.flatnonzero(np.concatenate(([True], trie[1:] != trie[:-1])))
        root = linked(rest, np.ascontiguousarray(rows["whole"]).view(np.uint64), starts, budget)
        hung = np.flatnonzero(root != np.arange(len(root)))
        if len(hung):
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["whole"][hung]), pa.array(rows["whole"][root[hung]])], names=["u", "v"])

    size = 0
    for batch in batches:
        rows = np.zeros(batch.num_rows, [("trie", "i8"), ("rest", "u8"), ("whole", "i8")])
        rows["trie"] = batch.column("trie").to_numpy()
        rows["rest"] = batch.column("rest").to_numpy().view(np.uint64)
        rows["whole"] = batch.column("whole").to_numpy()
        held.append(rows)
        size += len(rows)
        if size >= CHUNK_ROWS:
            rows = np.concatenate(held)
            cut = int(np.searchsorted(rows["trie"] == rows["trie"][-1], True))  # the last trie may go on
            if cut:
                yield from flush(rows[:cut])
            held, size = [rows[cut:]], len(rows) - cut
    if size:
        yield from flush(np.concatenate(held))


def _rotated(value: Column, by: int) -> Column:
    return value if by == 0 else F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, BITS - by))


def links(prints: DataFrame, budget: int = 3, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (u, v) that connect the distinct longs ``fingerprint`` exactly as all pairs within ``budget`` bits do.

    Each fingerprint is dealt to one trie per block (``budget`` + 1 rotations). A trie of more than ``group_rows``
    fingerprints is dealt out again by the blocks of its remaining bits, of which one must agree in every linked pair,
    until all are small or no bit is left; the walk in a task is therefore bounded whatever one block holds.
    """
    blocks = budget + 1
    step = BITS // blocks
    rows = prints.select(F.col("fingerprint").alias("whole"), F.explode(F.array(*[
        F.struct(F.lit(i).cast("long").alias("i"), _rotated(F.col("fingerprint"), i * step).alias("rest"))
        for i in range(blocks)])).alias("r")).select("whole", "r.i", "r.rest")
    left = BITS - step
    mask = lambda bits: (1 << bits) - 1 if bits < 63 else -1
    rows = rows.select(F.xxhash64("i", F.shiftrightunsigned("rest", left)).alias("trie"),
                       F.col("rest").bitwiseAND(F.lit(mask(left))).alias("rest"), "whole")
    done = []
    while left > blocks:
        large = rows.groupBy("trie").count().where(F.col("count") > group_rows).select("trie")
        if large.isEmpty():
            break
        rows = checkpointed(rows.join(large.withColumn("large", F.lit(True)), "trie", "left"), "tries")
        done.append(rows.where("large is null").drop("large"))
        step = -(-left // blocks)
        cuts = [(i * step, min(step, left - i * step)) for i in range(blocks) if i * step < left]
        turned = F.array(*[F.struct(
            F.lit(i).cast("long").alias("i"),
            F.shiftrightunsigned("rest", left - at - n).bitwiseAND(F.lit(mask(n))).alias("top"),
            F.shiftleft(F.shiftrightunsigned("rest", left - at), left - at - n).bitwiseOR(
                F.col("rest").bitwiseAND(F.lit(mask(left - at - n)))).alias("rest"))
            for i, (at, n) in enumerate(cuts)])
        rows = (rows.where("large").select("trie", "whole", F.explode(turned).alias("r"))
                .select(F.xxhash64("trie", "r.i", "r.top").alias("trie"), "r.rest", "whole"))
        left -= min(n for _, n in cuts)
    for part in done:
        rows = rows.unionByName(part)
    spread = rows.repartition("trie").sortWithinPartitions("trie", F.col("rest"))
    return spread.mapInArrow(lambda batches: _link_batches(batches, budget), "u long, v long")


def with_components(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, budget: int = 3) -> DataFrame:
    """One row (key, row, fingerprint, component, component_id) for each row of ``df``.

    Rows are near duplicates if a chain of fingerprints joins them whose neighbours differ in at most ``budget`` bits.
    ``component`` is the smallest fingerprint (as a signed long) of the chain and ``component_id`` the smallest
    non-null key; it is null if all keys are. ``row`` is a digest of key and text. Texts without a word, null ones
    included, share fingerprint zero. Equal fingerprints are one node, so copies are never paired.
    """
    slim = df.select(F.col(key).alias("key"), F.xxhash64(key, text).alias("row"), F.col(text).alias("text"))
    prints = checkpointed(with_fingerprints(slim, "text", "fingerprint", width).drop("text"), "fingerprints")
    distinct = checkpointed(prints.groupBy("fingerprint").agg(F.min("key").alias("least")), "distinct-fingerprints")
    nodes = components(links(distinct, budget)).select(F.col("node").alias("fingerprint"), F.col("root").alias("component"))
    least = nodes.join(distinct, "fingerprint").groupBy("component").agg(F.min("least").alias("component_id"))
    placed = nodes.join(least, "component")
    found = distinct.join(placed, "fingerprint", "left").select(
        "fingerprint", F.coalesce("component", "fingerprint").alias("component"),
        F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    # Written out, so that the join below has two plain shuffles and a fingerprint of very many copies is split.
    return prints.join(checkpointed(found, "components"), "fingerprint").select(
        F.col("key").alias(key), "row", "fingerprint", "component", "component_id")


def near_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, budget: int = 3) -> DataFrame:
    """The rows of ``df`` with one row left of each group of near duplicates, the one with the smallest key.

    A null key comes last; between equal keys a digest of the text decides, and of identical rows one stays.
    """
    return first_of_each(df, with_components(df, text, key, width, budget), text, key)


def first_of_each(df: DataFrame, rows: DataFrame, text: str, key: str) -> DataFrame:
    """The row of ``df`` with the smallest key of each component in ``rows`` (key, row, component)."""
    name = fresh(df, "_row")
    null = fresh(df, "_null")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "row")).alias("first"))
    kept = first.select(F.col("first.row").alias(name), F.col("first.none").alias(null), F.col("first.key").alias("_kept"))
    marked = df.withColumns({name: F.xxhash64(key, text), null: F.col(key).isNull()})
    same = [marked[name] == kept[name], marked[null] == kept[null], marked[key].eqNullSafe(kept["_kept"])]
    return marked.join(kept, same, "left_semi").dropDuplicates([name, null, key]).drop(name, null)
