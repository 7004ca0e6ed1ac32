"""Exact removal of byte strings that occur more than once, by suffix arrays built bucket by bucket.

Two equal strings of ``length`` bytes have the same smallest ``GRAM``-byte hash at the same place, so this anchor is
the bucket in which their suffixes meet. Every start position has one anchor; the starts of one anchor are a short
stretch (a context). Contexts that are equal as a whole are counted first, and each different one goes to its bucket
once, whatever its number of copies. In a bucket the suffixes are put in order by two-stage sorting and neighbours
with a common prefix of ``length`` bytes are repeats.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..schema import q
from ..session import checkpointed
from .texts import fresh, sliced, utf8

LENGTH = 200
GRAM = 32
BUCKET_CONTEXTS = 10_000
BATCH_BYTES = 600_000
SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


class _Rolling:
    """Polynomial hashes modulo 2**64 of any stretch of a byte array; two bases give independent hashes."""

    def __init__(self, base: np.uint64 = _BASE):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.codes = _mixed(np.arange(1, 257, dtype=np.uint64) * base)
        self.up = self.down = np.ones(1, np.uint64)

    def load(self, data: np.ndarray) -> None:
        if len(self.up) <= len(data):
            ones = np.ones(1, np.uint64)
            self.up = np.multiply.accumulate(np.concatenate((ones, np.full(len(data), self.base))))
            self.down = np.multiply.accumulate(np.concatenate((ones, np.full(len(data), self.inverse))))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.up[:len(data)], out=self.sums[1:])

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[high] - self.sums[low]) * self.down[low])

    def windows(self, width: int) -> np.ndarray:
        low = np.arange(max(0, len(self.sums) - width))
        return _mixed((self.sums[width:] - self.sums[:len(low)]) * self.down[:len(low)])


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks forwards and backwards."""
    n = len(values) - width + 1
    blocks = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:len(values)] = values
    blocks = blocks.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1:width - 1 + n])


def contexts_of(rolling: _Rolling, data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Stretches of starts with one anchor: text number, first start in the text, starts, anchor and whole-context hash."""
    if len(data) < length:
        return {name: np.zeros(0, np.int64) for name in ("text", "start", "n", "anchor", "context")}
    rolling.load(data)
    grams = rolling.windows(gram)
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)  # equal hashes: the first one
    at = (_lowest(keys, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(len(at) + 1, np.int32)
    sizes = np.diff(offsets)
    full = sizes >= length
    valid[offsets[:-1][full]] += 1
    np.add.at(valid, offsets[1:][full] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid)[:-1] > 0)
    if not len(starts):
        return {name: np.zeros(0, np.int64) for name in ("text", "start", "n", "anchor", "context")}
    at = at[starts]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)))
    first = starts[new]
    n = np.diff(np.append(np.flatnonzero(new), len(starts)))
    anchor = at[new]
    whole = rolling.of(first, first + n + length - 1)
    place = (anchor - first).astype(np.uint64) << np.uint64(32) | n.astype(np.uint64)
    text = np.searchsorted(offsets, first, side="right") - 1
    return {"text": text, "start": first - offsets[text], "n": n, "anchor": grams[anchor].view(np.int64),
            "context": _mixed(whole + place * _BASE).view(np.int64)}


# --- two-stage sorting -----------------------------------------------------------------------------------------------


def _sorted_suffixes(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The order of the strings data[low:high]: first by eight bytes at once, then ties among themselves."""
    words = np.zeros(len(low), np.uint64)
    for i in range(8):
        inside = low + i < high
        words = (words << np.uint64(8)) | np.where(inside, data[np.minimum(low + i, len(data) - 1)], 0).astype(np.uint64)
    order = np.argsort(words, kind="stable")
    words = words[order]
    new = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
    raw = data.tobytes()
    ends = np.append(new[1:], len(words))
    tied = ends - new > 1
    for a, b in zip(new[tied].tolist(), ends[tied].tolist()):
        group = order[a:b]
        keys = [raw[x:y] for x, y in zip(low[group].tolist(), high[group].tolist())]
        order[a:b] = group[sorted(range(b - a), key=keys.__getitem__)]
    return order


def suffix_order(data: np.ndarray, bounds: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The ``wanted`` starts (with those they are induced from) in the order of their suffixes' first ``depth`` bytes.

    ``bounds`` cut ``data`` into strings, and a suffix ends with its string. Suffixes smaller than their successor are
    sorted directly. The others are induced: buckets of first bytes are scanned upwards, and each suffix puts its
    predecessor at the next place of the predecessor's bucket if that begins with a larger byte, or with the same
    byte and is itself larger than its successor.
    """
    n, strings = len(data), len(bounds) - 1
    letters = np.zeros(n + strings, np.int16)  # a zero after each string sorts below every byte
    own = (np.arange(n) + np.repeat(np.arange(strings), np.diff(bounds))).astype(np.int32)
    letters[own] = data.astype(np.int16) + 1
    stops = bounds[1:] + np.arange(strings)
    size = len(letters)
    step = np.diff(letters, append=np.int16(0))  # positive: smaller than the successor's letter
    position = np.arange(size, dtype=np.int32)
    decided = np.where(step != 0, position, np.int32(size - 1))
    decided = np.minimum.accumulate(decided[::-1])[::-1]  # equal letters go with the first different one
    direct = step[decided] > 0
    direct[stops] = True  # ends of strings seed the scan
    following = np.minimum.accumulate(np.where(direct, position, np.int32(size - 1))[::-1])[::-1]

    seeds = following[own[wanted]]
    # Between a wanted suffix and the next one sorted directly all are induced, so all of them are needed.
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, own[wanted], 1)
    np.add.at(edge, seeds + 1, -1)
    need = np.cumsum(edge)[:-1] > 0

    sorted_directly = np.flatnonzero(need & direct & (letters > 0))
    string = np.searchsorted(stops, sorted_directly)
    low = sorted_directly - string
    sorted_directly = sorted_directly[_sorted_suffixes(data, low, np.minimum(low + depth, bounds[string + 1]))]
    heads = np.searchsorted(letters[sorted_directly], np.arange(258))

    pending: list[list[np.ndarray]] = [[] for _ in range(257)]
    found: list[np.ndarray] = []
    for letter in range(257):
        if letter == 0:
            bucket = [stops[need[stops]]]
        else:
            bucket, last = [], pending[letter]
            while last:  # the induced ones first; a run of one letter induces itself step by step
                now = np.concatenate(last)
                bucket.append(now)
                before = now - 1
                before = before[(letters[before] == letter) & need[before]]
                last = [before] if len(before) else []
            bucket.append(sorted_directly[heads[letter]:heads[letter + 1]])
        scanned = np.concatenate(bucket)
        if not len(scanned):
            continue
        if letter:
            found.append(scanned)
        before = scanned[scanned > 0] - 1
        before = before[(letters[before] > letter) & need[before]]
        if len(before):
            into = letters[before]
            by = np.argsort(into, kind="stable")
            before, into = before[by], into[by]
            cuts = np.flatnonzero(np.concatenate(([True], into[1:] != into[:-1])))
            for place, part in zip(into[cuts], np.split(before, cuts[1:])):
                pending[place].append(part)
        pending[letter] = []
    found = np.concatenate(found) if found else np.zeros(0, np.int64)
    return found - np.searchsorted(stops, found)


def common_prefixes(data: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """Equal leading bytes of the suffixes at ``left`` and ``right``, in whole steps of eight up to ``most``."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[:len(data)].copy().view(np.uint64).ravel()
    common = np.zeros(len(left), np.int64)
    alive = np.arange(len(left))
    for at in [*range(0, most - 7, 8), *([most - 8] if most % 8 else [])]:
        alive = alive[words[left[alive] + at] == words[right[alive] + at]]
        common[alive] = at + 8
    return common


def repeated(bodies: list[bytes], starts: np.ndarray, copies: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (body number, first start, starts) of the first ``starts[i]`` starts of each body whose string repeats."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(b) for b in bodies])))
    owner = np.repeat(np.arange(len(bodies)), starts)
    first = np.cumsum(starts) - starts
    eligible = bounds[:-1][owner] + np.arange(len(owner)) - first[owner]
    order = suffix_order(data, bounds, eligible, length + 8)
    is_start = np.zeros(len(data), bool)
    is_start[eligible] = True
    order = order[is_start[order]]
    equal = common_prefixes(data, order[:-1], order[1:], length) >= length
    hit = np.zeros(len(data), bool)
    hit[order[:-1][equal]] = True
    hit[order[1:][equal]] = True
    hit = hit[eligible] | (copies[owner] > 1)
    edges = np.concatenate(([True], owner[1:] != owner[:-1]))
    begin = np.flatnonzero(hit & (edges | ~np.concatenate(([False], hit[:-1]))))
    end = np.flatnonzero(hit & np.concatenate((edges[1:] | ~hit[1:], [True]))) + 1
    return owner[begin], begin - first[owner[begin]], end - begin


# --- Spark -----------------------------------------------------------------------------------------------------------


def _occurrences(rows: DataFrame, text: str, key: str, length: int, gram: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = _Rolling()
        for batch in sliced(batches, text, SLICE):
            data, offsets = utf8(batch.column(text))
            found = contexts_of(rolling, data, offsets, length, gram)
            row = batch.column(key).to_numpy()[found["text"]]
            for part in range(0, len(row), 100_000):
                cut = slice(part, part + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found["anchor"][cut]), pa.array(found["context"][cut]), pa.array(row[cut]),
                     pa.array(found["start"][cut].astype(np.int32)), pa.array(found["n"][cut].astype(np.int32))],
                    names=["anchor", "context", "row", "start", "n"])

    return rows.select(q(text), q(key)).mapInArrow(run, "anchor long, context long, row long, start int, n int")


def _bodies(rows: DataFrame, wanted: DataFrame, text: str, key: str, length: int) -> DataFrame:
    """The bytes of the wanted contexts, cut out of their texts."""
    asked = fresh(rows, "_wanted")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, SLICE):
            data, offsets = utf8(batch.column(text))
            lists = batch.column(asked)
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            parts = lists.flatten()
            fields = {name: parts.field(name) for name in ("anchor", "context", "copies", "start", "n")}
            low = offsets[:-1][owner] + fields["start"].to_numpy()
            high = low + fields["n"].to_numpy() + length - 1
            raw = data.tobytes()
            bodies = pa.array([raw[a:b] for a, b in zip(low.tolist(), high.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [fields["anchor"], fields["context"], fields["copies"], fields["n"], bodies],
                names=["anchor", "context", "copies", "n", "body"])

    per_row = wanted.groupBy(F.col("row").alias(key)).agg(F.collect_list(F.struct("anchor", "context", "copies", "start", "n")).alias(asked))
    # With all columns, so that this shuffle of the texts is the one that the removal uses again.
    return rows.join(per_row, key).mapInArrow(run, "anchor long, context long, copies long, n int, body binary")


def _sorted_runs(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts in the order of their anchors become runs of repeated starts, some buckets at a time."""
    anchors, contexts, copies, starts, bodies, size = [], [], [], [], [], 0

    def flush():
        owner, low, n = repeated(bodies, np.array(starts), np.array(copies), length)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(anchors)[owner]), pa.array(np.array(contexts)[owner]), pa.array(low.astype(np.int32)),
             pa.array(n.astype(np.int32))], names=["anchor", "context", "low", "many"])
        for held in (anchors, contexts, copies, starts, bodies):
            held.clear()

    for batch in batches:
        for anchor, context, many, n, body in zip(*(batch.column(c).to_pylist() for c in ("anchor", "context", "copies", "n", "body"))):
            if size >= BATCH_BYTES and anchor != anchors[-1]:
                yield from flush()
                size = 0
            anchors.append(anchor), contexts.append(context), copies.append(many), starts.append(n), bodies.append(body)
            size += len(body)
    if bodies:
        yield from flush()


def _digest_runs(contexts: DataFrame, length: int) -> DataFrame:
    """The same for buckets too large for a task: every suffix becomes a row under two hashes of its first bytes.

    Rows are counted, with partial sums before the shuffle, so no task holds a bucket.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _Rolling(), _Rolling(np.uint64(0xC2B2AE3D27D4EB4F))
        for batch in sliced(batches, "body", SLICE >> 2):
            n = batch.column("n").to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), n)
            low = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            data, offsets = utf8(batch.column("body"))
            first = offsets[:-1][owner] + low
            digests = []
            for rolling in pair:
                rolling.load(data)
                digests.append(pa.array(rolling.of(first, first + length).view(np.int64)))
            kept = [pa.array(batch.column(c).to_numpy()[owner]) for c in ("anchor", "context", "copies")]
            yield pa.RecordBatch.from_arrays([*digests, *kept, pa.array(low.astype(np.int32))],
                                             names=["one", "two", "anchor", "context", "copies", "low"])

    suffixes = checkpointed(contexts.mapInArrow(run, "one long, two long, anchor long, context long, copies long, low int"), "suffixes")
    twice = suffixes.groupBy("one", "two").agg(F.sum("copies").alias("total")).where("total > 1").select("one", "two")
    return suffixes.join(checkpointed(twice, "repeated-suffixes"), ["one", "two"]).select(
        "anchor", "context", "low", F.lit(1).alias("many"))


def repeated_spans(rows: DataFrame, text: str, key: str, length: int = LENGTH, gram: int = GRAM,
                   bucket_contexts: int = BUCKET_CONTEXTS) -> DataFrame:
    """Spans (row, low, high) in bytes, overlapping, that cover every string of ``length`` bytes found twice or more.

    ``key`` is a long that tells the rows apart. Anchors that occur once are dropped after a count with partial sums. A
    bucket of more than ``bucket_contexts`` different contexts is not sorted in one task; its suffixes are counted by
    digest instead, with the same result.
    """
    occurrences = _occurrences(rows, text, key, length, gram)
    shared = checkpointed(occurrences.groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    candidates = checkpointed(occurrences.join(shared, "anchor"), "candidates")
    contexts = checkpointed(
        candidates.groupBy("anchor", "context").agg(
            F.count("*").alias("copies"), F.min(F.struct("row", "start", "n")).alias("at"))
        .select("anchor", "context", "copies", "at.row", "at.start", "at.n"), "contexts")
    large = checkpointed(contexts.groupBy("anchor").count().where(F.col("count") > bucket_contexts).select("anchor"), "large-buckets")
    counted = None
    if not large.isEmpty():
        counted = _digest_runs(_bodies(rows, contexts.join(large, "anchor", "left_semi"), text, key, length), length)
        contexts = contexts.join(large, "anchor", "left_anti")
    ordered = _bodies(rows, contexts, text, key, length).repartition("anchor").sortWithinPartitions("anchor", "context")
    runs = ordered.mapInArrow(lambda batches: _sorted_runs(batches, length), "anchor long, context long, low int, many int")
    if counted is not None:
        runs = runs.unionByName(counted)
    return candidates.join(runs, ["anchor", "context"]).select(
        "row", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("low") + F.col("many") + (length - 1)).alias("high"))


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """``df`` with columns kept, n_bytes, n_removed and n_spans for the bytes of ``text``.

    ``kept`` is binary, or with ``as_text`` a string without the characters of which a removed byte was a part.

    Every byte covered by a string of ``length`` bytes that also starts elsewhere in the table is removed; strings are
    judged on the input. Null counts as empty; shorter texts stay whole; identical rows are copies of each other.
    Columns of ``df`` with one of the four names are replaced.
    """
    added = ("kept", "n_bytes", "n_removed", "n_spans")
    df = df.drop(*added)
    name, spans_name = fresh(df, "_row"), fresh(df, "_spans")
    marked = df.withColumn(name, F.xxhash64(key, text))
    spans = repeated_spans(marked, text, name, length)
    per_row = spans.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias(spans_name)).withColumnRenamed("row", name)
    joined = marked.join(per_row, name, "left")
    fields = list(df.schema.fields)
    schema = T.StructType(list(fields))
    for column, kind in zip(added, ("string" if as_text else "binary", "long", "long", "long")):
        schema = schema.add(column, kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            kept, counts = [], []
            data, offsets = utf8(batch.column(text))
            lists = batch.column(spans_name)
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy()))).tolist()
            parts = lists.flatten()
            lows, highs = parts.field("low").to_pylist(), parts.field("high").to_pylist()
            raw = data.tobytes()
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                pieces, at, number = [], 0, 0
                for low, high in zip(lows[ends[i]:ends[i + 1]], highs[ends[i]:ends[i + 1]]):
                    if low > at or not number:
                        pieces.append(raw[a + at:a + low])
                        number += 1
                    at = max(at, high)
                pieces.append(raw[a + at:b])
                kept.append(b"".join(pieces))
                counts.append((b - a, b - a - len(kept[-1]), number))
            if as_text:
                kept = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
            columns = [batch.column(f.name) for f in fields] + [kept if as_text else pa.array(kept, pa.binary())]
            columns += [pa.array(c, pa.int64()) for c in zip(*counts)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in fields), *added])

    return joined.mapInArrow(run, schema)
