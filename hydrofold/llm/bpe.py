"""Byte-level BPE, encoded by speculation: greedy longest matches are proposed and verified pair by pair.

A sequence of tokens is what the merges yield exactly if every two neighbours are what they yield for the two alone.
So the distinct words of a slice of texts are cut greedily, all neighbouring pairs are tested at once, and only words
with a failing pair are merged step by step.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .texts import sliced, utf8

SLICE = 1 << 20
KNOWN_WORDS = 200_000
#: Failing words of up to so many bytes are merged side by side, so many at once.
SHORT = 32
SIDE_BY_SIDE = 20_000
NEVER = np.iinfo(np.int64).max
# Fixed value: the pattern by which the vocabulary's publisher cuts text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and added tokens of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, letters = content["model"], _letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.ids = {as_bytes(token): i for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes = [b""] * size
        for token, i in self.ids.items():
            self.bytes[i] = token
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.rank = np.full(size, -1, np.int64)  # the merge that makes a token; single bytes have none
        self.left, self.right = np.arange(size), np.arange(size)
        self.merges: dict[int, int] = {}  # pairs (as one number) to the token they make
        for rank, merge in enumerate(model["merges"]):
            first, second = (as_bytes(t) for t in (merge.split(" ") if isinstance(merge, str) else merge))
            a, b, made = self.ids[first], self.ids[second], self.ids[first + second]
            self.merges[a << 32 | b] = made
            self.rank[made], self.left[made], self.right[made] = rank, a, b
        keys = np.fromiter(self.merges, np.int64, len(self.merges))
        order = np.argsort(keys)
        self.keys, self.key_made = keys[order], np.fromiter(self.merges.values(), np.int64, len(self.merges))[order]
        self.key_ranks = self.rank[self.key_made]
        self.reach: dict[bytes, int] = {}  # three bytes to the length of the longest token that they begin
        for token in self.ids:
            if len(token) > 2:
                self.reach[token[:3]] = max(len(token), self.reach.get(token[:3], 0))
        self.single = np.array([self.ids[bytes([i])] for i in range(256)], np.int64)
        self.sizes = np.array([len(b) for b in self.bytes])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(self.bytes), np.uint8)

    def propose(self, word: bytes) -> list[int]:
        """The longest token at each place, from the left."""
        ids, found, at, n = self.ids, [], 0, len(word)
        while at < n:
            for end in range(min(n, at + self.reach.get(word[at:at + 3], 2)), at, -1):
                token = ids.get(word[at:end])
                if token is not None:
                    found.append(token)
                    at = end
                    break
        return found

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave each pair of tokens as it is.

        Merges are undone from the last one back. While two pieces face each other at the border, a merge of both
        must come after the merge that takes one of them away: ``limit``. A merge of equal rank comes first if it
        stands further left.
        """
        good = np.ones(len(a), bool)
        alive, limit = np.arange(len(a)), np.full(len(a), np.iinfo(np.int64).max)
        a, b = a.astype(np.int64), b.astype(np.int64)
        while len(alive):
            key = (a << 32) | b
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            crossing = (self.keys[place] == key) & (self.key_ranks[place] < limit)
            good[alive[crossing]] = False
            go_on = ~crossing & ((self.rank[a] >= 0) | (self.rank[b] >= 0))
            alive, a, b = alive[go_on], a[go_on], b[go_on]
            undo_left = self.rank[a] > self.rank[b]
            limit = np.where(undo_left, self.rank[a], self.rank[b] + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return good

    def merged_all(self, words: list[bytes]) -> list[list[int]]:
        """``merged`` of many words: short ones of about one length are merged side by side, a step of each at a time."""
        found: list[list[int]] = [[]] * len(words)
        sizes = np.array([len(w) for w in words])
        lower = 0
        for upper in (8, 16, SHORT):
            some = np.flatnonzero((sizes > lower) & (sizes <= upper))
            for at in range(0, len(some), SIDE_BY_SIDE):
                part = some[at:at + SIDE_BY_SIDE].tolist()
                for i, tokens in zip(part, self._side_by_side([words[i] for i in part], upper)):
                    found[i] = tokens
            lower = upper
        for i in np.flatnonzero(sizes > SHORT).tolist():
            found[i] = self.merged(words[i])
        return found

    def _made(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair's merge and the token it makes; pairs that no merge joins come last."""
        key = (a << 32) | b
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        none = (self.keys[place] != key) | (a < 0) | (b < 0)
        return np.where(none, NEVER, self.key_ranks[place]), self.key_made[place]

    def _side_by_side(self, words: list[bytes], width: int) -> list[list[int]]:
        letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        places = np.arange(width)
        tokens = np.where(places < np.array([len(w) for w in words])[:, None], self.single[letters], -1)
        out = tokens.copy()
        rows = np.arange(len(words))
        ranks, made = self._made(tokens[:, :-1], tokens[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1)  # the leftmost of the lowest
            each = np.arange(len(rows))
            going = ranks[each, at] < NEVER
            out[rows[~going]] = tokens[~going]
            rows, tokens, ranks, made, at = rows[going], tokens[going], ranks[going], made[going], at[going]
            if not len(rows):
                break
            each = np.arange(len(rows))
            new = made[each, at]
            later = np.minimum(places + (places > at[:, None]), width - 1)
            ended = at < width - 1
            tokens = np.take_along_axis(tokens, later, axis=1)
            tokens[ended, -1] = -1
            tokens[each, at] = new
            ranks, made = (np.take_along_axis(x, later[:, :-1].clip(max=width - 2), axis=1) for x in (ranks, made))
            ranks[:, -1] = NEVER
            for side in (at - 1, at):
                fits = (side >= 0) & (side < width - 1)
                i, j = each[fits], side[fits]
                ranks[i, j], made[i, j] = self._made(tokens[i, j], tokens[i, j + 1])
        sizes = (out >= 0).sum(axis=1)
        return [row[:n] for row, n in zip(out.tolist(), sizes.tolist())]

    def merged(self, word: bytes) -> list[int]:
        """Merging step by step, lowest rank first and leftmost among equals."""
        tokens = [self.ids[word[i:i + 1]] for i in range(len(word))]
        after, before = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1))
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(tokens):
                made = self.merges.get(tokens[i] << 32 | tokens[after[i]])
                if made is not None:
                    heapq.heappush(heap, (int(self.rank[made]), i, tokens[i], tokens[after[i]], made))

        for i in range(len(tokens)):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j >= len(tokens) or tokens[j] != b:
                continue  # one of the two has gone into another merge
            tokens[i], tokens[j] = made, -1
            after[i] = after[j]
            if after[i] < len(tokens):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [t for t in tokens if t >= 0]

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each stretch of ids; bytes that are no UTF-8 become U+FFFD."""
        sizes = self.sizes[ids]
        after = np.concatenate(([0], np.cumsum(sizes)))
        raw = self.data[np.arange(after[-1]) + np.repeat(self.starts[ids] - after[:-1], sizes)].tobytes()
        cuts = after[offsets].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])]


class _Encoder:
    """Encodes slices of texts and remembers the words it has met, up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words = regex.compile(WORDS).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        v = self.vocabulary
        special = [None if w[0] != "\0" else v.special.get(w[1:]) for w in words]
        raw = [w.encode() for w in words]
        tokens = [v.propose(w) if s is None else [s] for w, s in zip(raw, special)]
        sizes = np.array([len(t) for t in tokens])
        flat = np.fromiter((t for ts in tokens for t in ts), np.int64, sizes.sum())
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique((flat[inner] << 32) | flat[inner + 1], return_inverse=True)
        good = v.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        failing = np.unique(owner[inner[~good[which]]]).tolist()
        for i, exact in zip(failing, v.merged_all([raw[i] for i in failing])):
            tokens[i] = exact
        sizes = np.array([len(t) for t in tokens])
        for w in words:
            self.known[w] = len(self.known)
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.flat = np.concatenate((self.flat, np.fromiter((t for ts in tokens for t in ts), np.uint32, sizes.sum())))

    def _cut(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.words(text)
        found, at = [], 0
        for match in self.special.finditer(text):
            found += self.words(text[at:match.start()])
            found.append("\0" + match.group())  # no word of the pattern joins a zero byte with letters
            at = match.end()
        return found + self.words(text[at:])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the offsets of the texts."""
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        words, ends = [], [0]
        for text in texts:
            words += self._cut(text)
            ends.append(len(words))
        new = [w for w in set(words) if w not in self.known]
        if new:
            self._learn(new)
        which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        sizes = self.sizes[which]
        after = np.concatenate(([0], np.cumsum(sizes)))
        at = np.arange(after[-1]) + np.repeat(self.starts[which] - after[:-1], sizes)
        return self.flat[at], after[ends]


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens",
           decoded: str | None = None) -> DataFrame:
    """``df`` plus the token ids of ``text`` as little-endian unsigned 32-bit integers end to end, and their number.

    ``vocabulary`` is the path of a byte-level tokenizer file, read by the driver and sent along with the tasks. Null
    and empty texts have no tokens. Added tokens that occur in a text get their own ids. ``decoded`` names a column for the
    text that the ids decode to, as ``decode`` would add it, without another pass.
    """
    fields = [f for f in df.schema.fields if f.name not in (ids, n_tokens, decoded)]
    schema = df.select(*(f"`{f.name}`" for f in fields)).schema.add(ids, "binary").add(n_tokens, "long")
    schema = schema.add(decoded, "string") if decoded else schema
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))  # of fixed size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(shared.value)
        for batch in sliced(batches, text, SLICE):
            flat, offsets = encoder([t or "" for t in batch.column(text).to_pylist()])
            packed = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [
                None, pa.py_buffer((offsets * 4).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat, "<u4"))]).cast(pa.binary())
            columns = [batch.column(f.name) for f in fields] + [packed, pa.array(np.diff(offsets))]
            columns += [pa.array(shared.value.texts(flat, offsets), pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` plus the text of ``ids`` (as ``encode`` packs them); bytes that are no UTF-8 become U+FFFD, null becomes empty."""
    fields = [f for f in df.schema.fields if f.name != decoded]
    schema = df.select(*(f"`{f.name}`" for f in fields)).schema.add(decoded, "string")
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in sliced(batches, ids, SLICE):
            data, offsets = utf8(batch.column(ids))
            texts = v.texts(np.frombuffer(data.tobytes(), "<u4"), offsets // 4)
            columns = [batch.column(f.name) for f in fields] + [pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in fields), decoded])

    return df.mapInArrow(run, schema)
