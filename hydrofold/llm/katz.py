"""Language-model scoring with Katz backoff: Good-Turing discounted bigrams over discounted words.

Texts become chunks of token numbers, each with a dictionary of its own words. Words are counted in parts by their hash,
and the counts go back to the chunks. Then every (history, word) pair goes to the part of its history, where counts,
discounts and backoff weights meet and each token is scored: by its bigram if training texts have it, else by the
history's backoff weight times the word, and a word that they lack by the weight left over for unknown words. All
that moves is packed per chunk and part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..schema import q
from ..session import checkpointed
from .texts import sliced

CHUNK_TOKENS = 2_000_000
CHUNK_BYTES = 8 << 20
PART_TOKENS = 2_000_000
PART_WORDS = 1_000_000
#: Counts up to this one are discounted.
DISCOUNTED = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)


# --- packing ---------------------------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Non-negative integer arrays as one compressed piece: the equal-weight bytes of each array's numbers lie together."""
    parts = [np.array([len(arrays)], "<i8").tobytes()]
    for array in arrays:
        wide = 8 if len(array) and array.max() >> 32 else 4
        parts.append(np.array([len(array), wide], "<i8").tobytes())
        parts.append(np.ascontiguousarray(array.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(piece: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(piece)
    found, at = [], 8
    for _ in range(int(np.frombuffer(raw, "<i8", 1)[0])):
        n, wide = np.frombuffer(raw, "<i8", 2, at).tolist()
        at += 16
        planes = np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n)
        found.append(np.ascontiguousarray(planes.T).view(f"<u{wide}").ravel().astype(np.int64))
        at += n * wide
    return found


def gaps(values: np.ndarray) -> np.ndarray:
    """Differences of a rising sequence, which pack better."""
    return np.diff(values, prepend=0)


# --- the model -------------------------------------------------------------------------------------------------------


def discounts(sizes: np.ndarray) -> np.ndarray:
    """Katz's factors for counts 0 to DISCOUNTED (index 0 unused), from the numbers of items of counts 1, 2, ...

    Where Good-Turing gives no factor between zero and one, because an item number is zero or they do not fall, half a
    count is taken off instead.
    """
    sizes = np.asarray(sizes, float)
    factors = np.ones(DISCOUNTED + 1)
    common = (DISCOUNTED + 1) * sizes[DISCOUNTED] / sizes[0] if sizes[0] else 1.0
    for r in range(1, DISCOUNTED + 1):
        turing = (r + 1) * sizes[r] / (r * sizes[r - 1]) if sizes[r - 1] else 0.0
        factor = (turing - common) / (1 - common) if common < 1 else 0.0
        factors[r] = factor if 0 < factor < 1 else (r - 0.5) / r
    return factors


def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return counts * factors[np.where(counts <= DISCOUNTED, counts, 0)]


class Words:
    """Word probabilities: discounted counts, and the mass taken off for all unknown words as one."""

    def __init__(self, sizes: np.ndarray, tokens: int, types: int):
        self.factors, self.tokens, self.types = discounts(sizes), tokens, types
        kept = discounted(np.arange(1, DISCOUNTED + 1), self.factors) * sizes[:DISCOUNTED]
        taken = (np.arange(1, DISCOUNTED + 1) * sizes[:DISCOUNTED]).sum() - kept.sum()
        self.total = tokens + (taken <= 0)  # nothing taken off: unknown words get one count
        self.unknown = max(taken, 1.0 if taken <= 0 else 0.0) / self.total if self.total else 1.0

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.factors) / max(self.total, 1), self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def backoff(total: np.ndarray, kept: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per history the divisor of its discounted counts, and the factor of the probabilities of words not seen after it.

    ``total`` are its training tokens, ``kept`` their discounted counts, ``covered`` the probability of the words seen.
    Seen and unseen words then sum to one exactly. A history that lost nothing to discounts gives away one more count,
    and one that was never seen passes words through.
    """
    divisor = total + (total - kept < 1e-9)
    return np.maximum(divisor, 1), np.where(total > 0, (divisor - kept) / np.maximum(divisor, 1) / np.maximum(1 - covered, 1e-300), 1.0)


# --- chunks ----------------------------------------------------------------------------------------------------------


def _chunks(rows: DataFrame, key_type) -> DataFrame:
    """One row per chunk: keys, held-out flags and sizes of its texts, its words' hashes and training counts, its tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in sliced(batches, "text", CHUNK_BYTES):
            known, tokens, sizes = {b"": 0}, [], []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode().lower().split()
                sizes.append(len(words) + 1)
                tokens += [known.setdefault(w, len(known)) for w in words]
                tokens.append(0)
            held = batch.column("held").to_numpy(zero_copy_only=False)
            tokens, sizes = np.array(tokens), np.array(sizes)
            counts = np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(known))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
            order = np.argsort(hashes)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("key")),
                 pa.array([pack(held.astype(np.int64), sizes)], pa.binary()), pa.array([hashes[order].tobytes()], pa.binary()),
                 pa.array([pack(counts[order])], pa.binary()), pa.array([pack(place[tokens])], pa.binary()),
                 pa.array([len(tokens)]), pa.array([len(known)])],
                names=["chunk", "keys", "texts", "hashes", "counts", "tokens", "n_tokens", "n_words"])
            number += 1

    return rows.mapInArrow(run, f"chunk long, keys array<{key_type}>, texts binary, hashes binary, counts binary, tokens binary, "
                                "n_tokens long, n_words long")


def _word_parts(batches: Iterable[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """A chunk's words and counts, cut by the part of their hash; the order within a part is that of the chunk."""
    for batch in batches:
        for chunk, hashes, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "hashes", "counts"))):
            hashes, (counts,) = np.frombuffer(hashes, np.uint64), unpack(counts)
            part = (hashes % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            pieces = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(parts)), pa.array(np.full(parts, chunk)), pa.array([hashes[p].tobytes() for p in pieces], pa.binary()),
                 pa.array([pack(counts[p]) for p in pieces], pa.binary())], names=["part", "chunk", "hashes", "counts"])


def _count_words(table: pa.Table, parts: int) -> pa.Table:
    """Numbers and training counts of one part's words, for each chunk that asked; and a row of statistics."""
    part = table.column("part")[0].as_py()
    hashes = [np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()]
    counts = [unpack(c)[0] for c in table.column("counts").to_pylist()]
    _, which = np.unique(np.concatenate(hashes), return_inverse=True)
    sums = np.bincount(which, np.concatenate(counts)).astype(np.int64)
    rank = np.empty(len(sums), np.int64)
    rank[np.argsort(-sums, kind="stable")] = np.arange(len(sums))  # frequent words get small numbers
    ends = np.cumsum([len(h) for h in hashes])
    answers = [pack(rank[w] * parts + part, sums[w]) for w in np.split(which, ends[:-1])]
    sizes = [int((sums == r).sum()) for r in range(1, DISCOUNTED + 2)]
    n = len(answers)
    return pa.table({
        "chunk": pa.array([*table.column("chunk").to_pylist(), -1]), "part": pa.array([part] * (n + 1)),
        "answer": pa.array([*answers, None], pa.binary()), "sizes": pa.array([*[None] * n, sizes], pa.list_(pa.int64())),
        "tokens": pa.array([*[None] * n, int(sums.sum())], pa.int64()), "types": pa.array([*[None] * n, int((sums > 0).sum())], pa.int64())})


# --- bigrams ---------------------------------------------------------------------------------------------------------


def _bigram_parts(chunks: pa.Table, answers: pa.Table, words: Words, texts: int, word_parts: int, parts: int, hot: float) -> pa.Table:
    """A chunk with its words' counts becomes one message of pairs for each part, and one of what is known of its texts.

    The part is that of the history; a history of more than ``hot`` training tokens is dealt over all parts by its words.
    """
    number = chunks.column("chunk")[0].as_py()
    held, sizes = unpack(chunks.column("texts")[0].as_py())
    hashes = np.frombuffer(chunks.column("hashes")[0].as_py(), np.uint64)
    (tokens,) = unpack(chunks.column("tokens")[0].as_py())
    part = (hashes % np.uint64(word_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    answered = sorted(zip(answers.column("part").to_pylist(), answers.column("answer").to_pylist()))
    ids, counts = (np.empty(len(hashes), np.int64) for _ in range(2))
    ids[order], counts[order] = (np.concatenate(c) for c in zip(*(unpack(a) for _, a in answered)))
    text = np.repeat(np.arange(len(sizes)), sizes)
    of_token = counts[tokens]
    known = np.bincount(text, of_token > 0, len(sizes)).astype(np.int64)
    base = np.bincount(text, words.base(of_token), len(sizes))

    before = np.empty(len(tokens), np.int64)  # numbers of histories are shifted by one; zero is the start of a text
    before[1:] = ids[tokens[:-1]] + 1
    before_count = np.empty(len(tokens), np.int64)
    before_count[1:] = of_token[:-1]
    first = np.cumsum(sizes) - sizes
    before[first], before_count[first] = 0, texts  # every training text starts once
    spread = before_count > hot
    mixed = before.astype(np.uint64) * _STEP
    mixed = np.where(spread, mixed ^ (ids[tokens].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), mixed)
    to = ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((tokens, before, to))
    cuts = np.searchsorted(to[order], np.arange(parts + 1))
    messages = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        mine = order[a:b]
        if not len(mine):
            messages.append(None)
            continue
        h = before[mine]
        new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        local, w = np.unique(tokens[mine], return_inverse=True)
        by = np.argsort(ids[local])  # the message's words by rising number
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        messages.append(pack(gaps(h[new]), before_count[mine][new], np.diff(np.append(new, len(h))), gaps(ids[local][by]),
                             counts[local][by], place[w], text[mine], held))
    full = [i for i, m in enumerate(messages) if m is not None]
    n = len(full)
    return pa.table({
        "part": pa.array([*full, number % parts]), "chunk": pa.array([number] * (n + 1)),
        "message": pa.array([*(messages[i] for i in full), None], pa.binary()),
        "known": pa.array([*[None] * n, known.tolist()], pa.list_(pa.int64())),
        "base": pa.array([*[None] * n, base.tolist()], pa.list_(pa.float64()))})


class _Part:
    """All messages of one part, with their pairs matched."""

    def __init__(self, table: pa.Table, words: Words):
        self.chunks = table.column("chunk").to_pylist()
        pieces = [unpack(m) for m in table.column("message").to_pylist()]
        join = lambda i: np.concatenate([p[i] for p in pieces])
        self.histories, h_of = np.unique(np.concatenate([np.cumsum(p[0]) for p in pieces]), return_inverse=True)
        self.totals = np.zeros(len(self.histories), np.int64)
        self.totals[h_of] = join(1)
        word_ids, w_of = np.unique(np.concatenate([np.cumsum(p[3]) for p in pieces]), return_inverse=True)
        counts = np.zeros(len(word_ids), np.int64)
        counts[w_of] = join(4)
        self.chance = words(counts)
        h_start = np.cumsum([0, *(len(p[0]) for p in pieces)])
        w_start = np.cumsum([0, *(len(p[3]) for p in pieces)])
        history = np.concatenate([np.repeat(h_of[a:a + len(p[0])], p[2]) for a, p in zip(h_start, pieces)])
        word = np.concatenate([w_of[a + p[5]] for a, p in zip(w_start, pieces)])
        self.text = [p[6] for p in pieces]
        self.texts = [len(p[7]) for p in pieces]
        train = np.concatenate([p[7][p[6]] == 0 for p in pieces])
        pair, self.pair_of = np.unique(history * len(word_ids) + word, return_inverse=True)
        self.times = np.bincount(self.pair_of, train, len(pair)).astype(np.int64)
        self.history, self.word = pair // max(1, len(word_ids)), pair % max(1, len(word_ids))

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.history, values, len(self.histories))


def _pair_sizes(table: pa.Table, words: Words, hot: float) -> pa.Table:
    """How many pairs occur once, twice, ...; and for each spread history what its pairs here add up to."""
    table = table.filter(table.column("message").is_valid())
    schema = {"history": pa.int64(), "sizes": pa.list_(pa.int64()), "often": pa.int64(), "covered": pa.float64()}
    if not table.num_rows:
        return pa.table({k: pa.array([], t) for k, t in schema.items()})
    part = _Part(table, words)
    rows = [(-1, [int((part.times == r).sum()) for r in range(1, DISCOUNTED + 2)], 0, 0.0)]
    for i in np.flatnonzero(part.totals > hot).tolist():
        mine = part.history == i
        times = part.times[mine]
        rows.append((int(part.histories[i]), [int((times == r).sum()) for r in range(1, DISCOUNTED + 2)],
                     int(times[times > DISCOUNTED].sum()), float(part.chance[part.word[mine]][times > 0].sum())))
    return pa.table({k: pa.array(c, t) for (k, t), c in zip(schema.items(), zip(*rows))})


def _score_part(table: pa.Table, words: Words) -> pa.Table:
    """Sums of log10 probabilities per text of each message; what is known of texts passes through."""
    told = table.filter(table.column("message").is_null()).select(["chunk", "known", "base"])
    table = table.filter(table.column("message").is_valid())
    chunks, lists, sums = [], [], []
    if table.num_rows:
        part = _Part(table, words)
        factors = discounts(np.array(table.column("pair_sizes")[0].as_py()))
        kept, covered = part.sums(discounted(part.times, factors)), part.sums(np.where(part.times > 0, part.chance[part.word], 0.0))
        for row in table.column("spread")[0].as_py():  # histories dealt over all parts: their sums over all of them
            at = np.flatnonzero(part.histories == row["history"])
            few = np.arange(1, DISCOUNTED + 1) * np.array(row["sizes"][:DISCOUNTED])
            kept[at], covered[at] = (few * factors[1:]).sum() + row["often"], row["covered"]
        divisor, weight = backoff(part.totals, kept, covered)
        seen = np.log10(np.maximum(discounted(part.times, factors), 1e-300) / divisor[part.history])
        unseen = np.log10(weight[part.history]) + np.log10(part.chance[part.word])
        score = np.where(part.times > 0, seen, unseen)[part.pair_of]
        at = 0
        for chunk, text, n in zip(part.chunks, part.text, part.texts):
            summed = np.bincount(text, score[at:at + len(text)], n)
            here = np.unique(text)
            chunks.append(chunk), lists.append(here.tolist()), sums.append(summed[here].tolist())
            at += len(text)
    n, m = len(chunks), told.num_rows
    return pa.table({
        "chunk": pa.array([*chunks, *told.column("chunk").to_pylist()], pa.int64()),
        "text": pa.array([*lists, *[None] * m], pa.list_(pa.int64())), "sum": pa.array([*sums, *[None] * m], pa.list_(pa.float64())),
        "known": pa.array([*[None] * n, *told.column("known").to_pylist()], pa.list_(pa.int64())),
        "base": pa.array([*[None] * n, *told.column("base").to_pylist()], pa.list_(pa.float64()))})


def _score_chunk(chunks: pa.Table, sums: pa.Table, key: str, tokens: int) -> pa.Table:
    """The rows of one chunk's texts."""
    held, sizes = unpack(chunks.column("texts")[0].as_py())
    score = np.zeros(len(sizes))
    known, base = np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
    for text, part, k, b in zip(*(sums.column(c).to_pylist() for c in ("text", "sum", "known", "base"))):
        if text is None:
            known, base = np.array(k), np.array(b)
        else:
            score[text] += part
    keys = chunks.column("keys").combine_chunks().flatten()
    return pa.table({key: keys, "held_out": pa.array(held.astype(bool)), "n_tokens": pa.array(sizes), "n_known": pa.array(known),
                     "train_tokens": pa.array(np.full(len(sizes), tokens)), "base_score": pa.array(base), "score": pa.array(score)})


def scored(df: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id", part_tokens: int = PART_TOKENS,
           part_words: int = PART_WORDS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row; the model learns from the others.

    Scores are log10 probabilities of the words and the end of a text, ``base_score`` that of single words with half a
    count added. Null texts are empty and have the end only; a null ``held_out`` counts as false. Without any training
    text every word is unknown and scores zero. The numbers of parts follow the numbers of words and tokens, so a part
    stays as large as it is; histories that would fill a part are dealt over all of them.
    """
    field = df.schema[key].dataType.simpleString()
    rows = df.select(q(key).alias("key"), q(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    chunks = checkpointed(_chunks(rows, field), "chunks")
    texts_of = df.where(~F.coalesce(held_out, F.lit(False))).count()
    total = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    parts, word_parts = max(1, -(-total[0] // part_tokens)), max(1, -(-total[1] // part_words))

    asked = chunks.select("chunk", "hashes", "counts").mapInArrow(
        lambda batches: _word_parts(batches, word_parts), "part long, chunk long, hashes binary, counts binary")
    answers = checkpointed(asked.repartition(word_parts, "part").groupBy("part").applyInArrow(
        lambda table: _count_words(table, word_parts), "chunk long, part long, answer binary, sizes array<long>, tokens long, types long"), "words")
    known = answers.where("chunk = -1").agg(
        *(F.coalesce(F.sum(F.col("sizes")[r]), F.lit(0)) for r in range(DISCOUNTED + 1)), F.coalesce(F.sum("tokens"), F.lit(0)),
        F.coalesce(F.sum("types"), F.lit(0))).first()
    words = Words(np.array(known[:DISCOUNTED + 1]), known[-2], known[-1])
    hot = max(words.tokens / parts / 2, 1)

    def send(chunk, answer):
        return _bigram_parts(chunk, answer, words, texts_of, word_parts, parts, hot)

    sent = chunks.groupBy("chunk").cogroup(answers.where("chunk >= 0").select("chunk", "part", "answer").groupBy("chunk")).applyInArrow(
        send, "part long, chunk long, message binary, known array<long>, base array<double>").repartition(parts, "part")
    sizes = sent.groupBy("part").applyInArrow(
        lambda table: _pair_sizes(table, words, hot), "history long, sizes array<long>, often long, covered double")
    per_history = sizes.groupBy("history").agg(
        F.array(*(F.sum(F.col("sizes")[r]) for r in range(DISCOUNTED + 1))).alias("sizes"), F.sum("often").alias("often"), F.sum("covered").alias("covered"))
    all_of_it = per_history.agg(  # one row; at most two spread histories a part
        F.coalesce(F.max(F.when(F.col("history") == -1, F.col("sizes"))), F.array(*[F.lit(0).cast("long")] * (DISCOUNTED + 1))).alias("pair_sizes"),
        F.collect_list(F.when(F.col("history") >= 0, F.struct("history", "sizes", "often", "covered"))).alias("spread"))
    sums = sent.crossJoin(F.broadcast(all_of_it)).groupBy("part").applyInArrow(
        lambda table: _score_part(table, words), "chunk long, text array<long>, sum array<double>, known array<long>, base array<double>")
    return chunks.select("chunk", "keys", "texts").groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(
        lambda chunk, found: _score_chunk(chunk, found, key, words.tokens),
        f"`{key}` {field}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
