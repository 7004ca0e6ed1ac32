"""Alignment of two tokenizations of the same texts, and how often their tokens meet across a corpus.

Both tokenizers end a token before a space between two visible characters, so a text is cut there into words whose
tokens are looked up once; longer runs of words are the rows of a lockstep merge. One state vector holds a pointer into
the A tokens and one into the B tokens of each row; a step advances the pointer whose token ends first, or both at a
common end, which cuts a group and emits its links. Finished rows are taken out of the vector.

What links mean for a document depends on the whole corpus. So documents are written in chunks: a chunk counts each of
its distinct pairs once, the counts are summed over chunks, sent back to the chunks that asked, and applied there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..schema import q
from ..session import checkpointed
from .bpe import WORDS, Vocabulary
from .texts import sliced, utf8

#: Text of so many characters is aligned at once; longer documents are carried on from one stretch to the next.
STRETCH = 1 << 20
#: Words of a row of the lockstep merge.
ROW_WORDS = 32
#: Distinct pairs of all documents of a chunk.
CHUNK_LINKS = 1 << 20
#: New words that B takes at once; it is slower on longer texts.
RUN_WORDS = 64
#: Chunks that a task gets its answers for, on average.
TASK_CHUNKS = 2
KNOWN_WORDS = 250_000
KNOWN_CHARACTERS = 8 << 20
#: A group of more links than this is counted by its distinct tokens instead of link by link.
LARGE_GROUP = 1 << 12
SLICE = 1 << 20
CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
#: Words that a space does not part from their neighbours in both tokenizations, or that B does not give back.
LONE = re.compile(r"^\s|▁|\s$")
#: The pattern's publisher's library cannot match longer runs of white space.
LONG_SPACE = re.compile(r"\s{1000}")


class Tokenizers:
    """The two tokenizers' files, as sent to workers: A is a byte-level vocabulary, B a piece model with byte fallback."""

    def __init__(self, vocabulary: str, pieces: str):
        with open(vocabulary, encoding="utf-8") as file:
            self.vocabulary = file.read()
        with open(pieces, "rb") as file:
            self.pieces = file.read()
        known = Vocabulary(vocabulary)
        if any(known.rank[m] != i for i, m in enumerate(known.merges.values())) or any(
                a >= b for a, b in zip(list(known.merges.values()), list(known.merges.values())[1:])):
            raise ValueError("the ids of merged tokens must grow with their ranks")
        self.ranks = known.ids
        self.name = hashlib.sha256(self.vocabulary.encode() + self.pieces).hexdigest()


class _Pair:
    """Both tokenizers at work: ids and byte lengths of the tokens of words."""

    def __init__(self, files: Tokenizers):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=files.ranks, special_tokens={})
        self.plain = Tokenizer.from_str(files.vocabulary)
        self.plain.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.pieces)
        a_bytes = [b""] * (1 + max(files.ranks.values()))
        for token, i in files.ranks.items():
            a_bytes[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes = a_bytes, b_bytes
        self.size = tuple(np.array([len(t) for t in side], np.int64) for side in self.bytes)
        self.start = tuple(np.cumsum(size) - size for size in self.size)
        self.data = tuple(np.frombuffer(b"".join(side), np.uint8) for side in self.bytes)

    def words(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and for B, the ids of each word with the space before it end to end, and each word's number of ids.

        A word has none in either where the bytes of one differ from it. Words are encoded as one text, in which
        spaces join them as they do in texts, and by themselves where a space would not part them from their neighbours.
        """
        odd = np.array([LONE.search(w) is not None or LONG_SPACE.search(w) is not None for w in words])
        joined = self._joined([w for w, o in zip(words, odd) if not o])
        if joined is None:
            odd[:] = True
            joined = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))] * 2
        if not odd.any():
            return joined
        alone = [self._alone(w) for w, o in zip(words, odd) if o]
        found = []
        for side, (ids, sizes) in enumerate(joined):
            all_sizes = np.zeros(len(words), np.int64)
            all_sizes[~odd], all_sizes[odd] = sizes, [len(x[side]) for x in alone]
            first = np.cumsum(all_sizes) - all_sizes
            flat, owner = np.zeros(all_sizes.sum(), np.uint32), np.repeat(odd, all_sizes)
            flat[~owner] = ids
            for at, x in zip(first[odd], alone):
                flat[at:at + len(x[side])] = x[side]
            found.append((flat, all_sizes))
        return found

    def _joined(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]] | None:
        if not words:
            return [(np.zeros(0, np.uint32), np.zeros(0, np.int64))] * 2
        text = " ".join(words)
        whole = np.frombuffer(b" " + text.encode(), np.uint8)
        ends = np.cumsum([1 + len(w.encode()) for w in words])
        found = []
        runs = self.b.encode([" ".join(words[at:at + RUN_WORDS]) for at in range(0, len(words), RUN_WORDS)], num_threads=1)
        for side, ids in enumerate((self.a.encode_to_numpy(" " + text, disallowed_special=()), np.fromiter(chain.from_iterable(runs), np.uint32))):
            size, start = self.size[side][ids], self.start[side][ids]
            token_ends = np.cumsum(size)
            if token_ends[-1] != len(whole) or not np.array_equal(self.data[side][np.arange(len(whole)) + np.repeat(start - token_ends + size, size)], whole):
                return None
            found.append((ids, np.diff(np.searchsorted(token_ends, ends, side="right"), prepend=0)))
        return found

    def _alone(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        ids = self._a(word), np.array(self.b.encode(word, num_threads=1), np.uint32)
        whole = b" " + word.encode()
        if any(b"".join(map(names.__getitem__, x.tolist())) != whole for names, x in zip(self.bytes, ids)):
            return (np.zeros(0, np.uint32),) * 2
        return ids

    def _a(self, word: str) -> np.ndarray:
        if LONG_SPACE.search(word):
            return np.array(self.plain.encode(" " + word, add_special_tokens=False).ids, np.uint32)
        return np.array(self.a.encode_ordinary(" " + word), np.uint32)


class _Words:
    """Remembers the tokens of words, up to a bound."""

    def __init__(self, pair: _Pair):
        self.pair = pair
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.characters = 0
        self.flat = [np.zeros(0, np.uint32)] * 2
        self.starts, self.sizes = [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2

    def numbers(self, words: list[str]) -> np.ndarray:
        """Each word's number in this memory."""
        if len(self.known) > KNOWN_WORDS or self.characters > KNOWN_CHARACTERS:
            self.forget()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            for side, (ids, sizes) in enumerate(self.pair.words(new)):
                self.starts[side] = np.concatenate((self.starts[side], len(self.flat[side]) + np.cumsum(sizes) - sizes))
                self.sizes[side] = np.concatenate((self.sizes[side], sizes))
                self.flat[side] = np.concatenate((self.flat[side], ids))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.characters += sum(map(len, new))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def tokens(self, which: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered words end to end, and each word's end."""
        sizes = self.sizes[side][which]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[side][which] - ends + sizes, sizes)
        return self.flat[side][at].astype(np.int64), ends


class Merged:
    """What a lockstep merge emits: cuts as flags of the last token of each group, and links of tokens and their groups."""

    def __init__(self, n_a: int, n_b: int):
        self.a_ends, self.b_ends = np.zeros(n_a, bool), np.zeros(n_b, bool)
        self.links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # a token, b token, times
        self.ids: tuple[np.ndarray, np.ndarray] | None = None

    def cut(self, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> None:
        """Groups of tokens [a0, a1) and [b0, b1); every token of one side links to every token of the other."""
        self.a_ends[a1 - 1], self.b_ends[b1 - 1] = True, True
        n_a, n_b = a1 - a0, b1 - b0
        size = n_a * n_b
        if size.max() == 1:
            self.links.append((a0, b0, np.ones(len(a0), np.int64)))
            return
        for i in np.flatnonzero(size > LARGE_GROUP):
            sides = []
            for ids, start, end in ((self.ids[0], a0[i], a1[i]), (self.ids[1], b0[i], b1[i])):
                _, first, times = np.unique(ids[start:end], return_index=True, return_counts=True)
                sides.append((start + first, times))
            (a, a_times), (b, b_times) = sides
            self.links.append((np.repeat(a, len(b)), np.tile(b, len(a)), (a_times[:, None] * b_times[None, :]).ravel()))
        small = size <= LARGE_GROUP
        a0, b0, n_b, size = a0[small], b0[small], n_b[small], size[small]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        width = np.repeat(n_b, size)
        self.links.append((np.repeat(a0, size) + inside // width, np.repeat(b0, size) + inside % width, np.ones(len(inside), np.int64)))


def lockstep(a_ids: np.ndarray, b_ids: np.ndarray, a_byte_ends: np.ndarray, b_byte_ends: np.ndarray,
             a_starts: np.ndarray, b_starts: np.ndarray, a_last: np.ndarray) -> Merged:
    """Merges all rows at once. ``a_starts`` and ``b_starts`` are the rows' first tokens, ``a_last`` where their A tokens end.

    The byte ends count from the beginning of all rows. A row's A and B tokens end at the same byte.
    """
    out = Merged(len(a_ids), len(b_ids))
    out.ids = a_ids, b_ids
    some = a_last > a_starts
    a, b, last = a_starts[some], b_starts[some], a_last[some]
    group_a, group_b = a.copy(), b.copy()
    while len(a):
        a_end, b_end = a_byte_ends[a], b_byte_ends[b]
        cut = a_end == b_end
        a, b = a + (a_end <= b_end), b + (b_end <= a_end)
        if cut.any():
            out.cut(group_a[cut], a[cut], group_b[cut], b[cut])
            group_a, group_b = np.where(cut, a, group_a), np.where(cut, b, group_b)
            going = a < last
            if not going.all():
                a, b, last, group_a, group_b = a[going], b[going], last[going], group_a[going], group_b[going]
    return out


@lru_cache(1)
def _digits(size: int) -> np.ndarray:
    """The decimal digits of every id in a row of bytes, with room for a separator; zero bytes stand for nothing."""
    width = len(str(size - 1))
    shown = np.zeros((size, width + 1), np.uint8)
    for i in range(size):
        text = str(i).encode()
        shown[i, :len(text)] = np.frombuffer(text, np.uint8)
    return shown


class _Document:
    """What has been found of a document up to now."""

    def __init__(self, key, number: int):
        self.key, self.number = key, number
        self.good, self.sums = True, np.zeros(4, np.int64)  # A tokens, B tokens, groups, links
        self.groups = hashlib.sha256()
        self.text: list[bytes] | None = None


class _Stretches:
    """Texts cut into stretches of about ``STRETCH`` characters: (document, words, whether it ends there), many at a time."""

    def __init__(self):
        self.held: list[tuple[_Document, list[str], bool]] = []
        self.size = 0

    def add(self, document: _Document, text: str) -> Iterator[list]:
        at = 0
        while True:
            cut = CUT.search(text, at + STRETCH) if len(text) - at > STRETCH else None
            end = cut.start() if cut else len(text)
            self.held.append((document, CUT.split(text[at:end]), cut is None))
            self.size += end - at
            if self.size >= STRETCH:
                yield self.take()
            if cut is None:
                return
            at = end + 1

    def take(self) -> list:
        held, self.held, self.size = self.held, [], 0
        return held


class _Aligner:
    def __init__(self, files: Tokenizers, keep_text: bool):
        self.pair = _pair(files)
        self.words = _Words(self.pair)
        self.keep_text = keep_text
        self.n_b_ids = len(self.pair.size[1])
        self.digits = _digits(max(len(self.pair.size[0]), self.n_b_ids))

    def __call__(self, stretches: list[tuple[_Document, list[str], bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Adds a stretch to each document's sums and groups; (document's number, pair, links) of the distinct pairs of each."""
        which = self.words.numbers([w for _, words, _ in stretches for w in words])
        ends = np.cumsum([len(words) for _, words, _ in stretches])
        starts = ends - [len(words) for _, words, _ in stretches]
        known = np.concatenate(([0], np.cumsum(self.words.sizes[0][which] > 0)))
        for i, (document, _, _) in enumerate(stretches):
            document.good &= bool(known[ends[i]] - known[starts[i]] == ends[i] - starts[i])
        good = np.flatnonzero([document.good for document, _, _ in stretches])
        if not len(good):
            return (np.zeros(0, np.int64),) * 3
        keep = np.concatenate([np.arange(starts[i], ends[i]) for i in good])
        which, n_words = which[keep], (ends - starts)[good]
        a_ids, a_ends = self.words.tokens(which, 0)
        b_ids, b_ends = self.words.tokens(which, 1)
        last = np.cumsum(n_words) - 1  # the last word of each stretch
        a_of, b_of = a_ends[last], b_ends[last]  # where the stretches' tokens end
        first = np.concatenate([np.arange(e - n + 1, e + 1, ROW_WORDS) for e, n in zip(last, n_words)])  # rows' first words
        row_ends = np.append(first[1:], len(which))
        before = lambda e: np.where(first > 0, e[first - 1], 0)
        merged = lockstep(a_ids, b_ids, np.cumsum(self.pair.size[0][a_ids]), np.cumsum(self.pair.size[1][b_ids]),
                          before(a_ends), before(b_ends), a_ends[row_ends - 1])
        a_group, b_group = (np.cumsum(e) - e for e in (merged.a_ends, merged.b_ends))
        group_of = np.cumsum(merged.a_ends)[a_of - 1]  # groups up to each stretch's end
        self._write(stretches, good, a_ids, b_ids, merged, a_group, b_group, a_of, b_of)
        of, at, times = (np.concatenate(c) for c in zip(*merged.links))
        owner = np.searchsorted(a_of, of, side="right")
        links = np.bincount(owner, times, len(good)).astype(np.int64)
        for i, sums in zip(good, np.diff(np.stack((a_of, b_of, group_of)), axis=1, prepend=0).T):
            stretches[i][0].sums[:3] += sums
        for i, n in zip(good, links):
            stretches[i][0].sums[3] += n
        pairs = len(self.pair.size[0]) * self.n_b_ids
        local = owner * pairs + a_ids[of] * self.n_b_ids + b_ids[at]
        if times.max() == 1:
            distinct, counts = np.unique(local, return_counts=True)
        else:
            distinct, inverse = np.unique(local, return_inverse=True)
            counts = np.bincount(inverse, times).astype(np.int64)
        numbers = np.array([stretches[i][0].number for i in good], np.int64)
        return numbers[distinct // pairs], distinct % pairs, counts

    def _write(self, stretches, good, a_ids, b_ids, merged, a_group, b_group, a_of, b_of) -> None:
        """The groups of each stretch as text: ids of A and of B joined by commas, A | B, groups joined by semicolons."""
        a_in, b_in = np.bincount(a_group), np.bincount(b_group)
        place_a = np.arange(len(a_ids)) + (np.cumsum(b_in) - b_in)[a_group]
        place_b = np.arange(len(b_ids)) + np.cumsum(a_in)[b_group]
        shown = np.zeros((len(a_ids) + len(b_ids), self.digits.shape[1]), np.uint8)
        shown[place_a], shown[place_b] = self.digits[a_ids], self.digits[b_ids]
        shown[place_a, -1] = np.where(merged.a_ends, ord("|"), ord(","))
        shown[place_b, -1] = np.where(merged.b_ends, ord(";"), ord(","))
        ends = a_of + b_of
        for i, end in zip(good, ends):
            if stretches[i][2]:
                shown[end - 1, -1] = 0
        used = shown != 0
        cuts = np.concatenate(([0], np.cumsum(used.sum(axis=1))[ends - 1]))
        data = shown[used].tobytes()
        for i, start, end in zip(good, cuts, cuts[1:]):
            document = stretches[i][0]
            if self.keep_text:
                document.text = [*(document.text or []), data[start:end]]
            else:
                document.groups.update(data[start:end])


_PAIRS: dict[str, _Pair] = {}


def _pair(files: Tokenizers) -> _Pair:
    """The tokenizers of this worker, built once."""
    if files.name not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[files.name] = _Pair(files)
    return _PAIRS[files.name]


class _Chunk:
    """Finished documents and the distinct pairs of each, until there are enough for a chunk."""

    def __init__(self, key_type: pa.DataType):
        self.key_type, self.number = key_type, 0
        self.documents: list[_Document] = []
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def new(self, key) -> _Document:
        self.documents.append(_Document(key, len(self.documents)))
        return self.documents[-1]

    def add(self, found) -> None:
        self.found.append(found)
        self.size += len(found[0])

    def batches(self, task: int, names: list[str]) -> Iterator[pa.RecordBatch]:
        """The chunk's distinct pairs with their documents' number, then the documents with the places of their pairs."""
        if not self.documents:
            return
        chunk = task << 32 | self.number
        good = np.array([d.good for d in self.documents])
        owner, pair, times = (np.concatenate(c) for c in zip(*(self.found or [(np.zeros(0, np.int64),) * 3])))
        owner, pair, times = (c[good[owner]] for c in (owner, pair, times))
        order = np.lexsort((pair, owner))  # a document of several stretches has some pairs twice
        owner, pair, times = owner[order], pair[order], times[order]
        first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])))) if len(pair) else np.zeros(0, np.int64)
        times = np.add.reduceat(times, first) if len(first) else times
        owner, pair = owner[first], pair[first]
        distinct, at, n = np.unique(pair, return_inverse=True, return_counts=True)
        for start in range(0, len(distinct), 100_000):
            part = slice(start, start + 100_000)
            size = len(distinct[part])
            columns = {"chunk": np.full(size, chunk), "kind": np.zeros(size, np.int32), "pair": distinct[part], "n": n[part]}
            yield self._batch(columns, size, names)
        ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(self.documents)))))
        for start in range(0, len(self.documents), 500):
            some = self.documents[start:start + 500]
            cuts = ends[start:start + len(some) + 1]
            sums = np.array([d.sums * d.good for d in some])
            text = [(b"".join(d.text or []).decode() if d.text is not None else d.groups.hexdigest() if d.sums[0] else "") if d.good else "" for d in some]
            columns = {"chunk": np.full(len(some), chunk), "kind": np.ones(len(some), np.int32), "pair": np.arange(start, start + len(some)),
                       "key": pa.array([d.key for d in some], self.key_type), "n_a": sums[:, 0], "n_b": sums[:, 1], "n_groups": sums[:, 2],
                       "n_links": sums[:, 3], "groups": pa.array(text, pa.string()),
                       "at": _packed(at[cuts[0]:cuts[-1]], cuts - cuts[0]), "times": _packed(times[cuts[0]:cuts[-1]], cuts - cuts[0])}
            yield self._batch(columns, len(some), names)
        self.documents, self.found, self.size, self.number = [], [], 0, self.number + 1

    def _batch(self, columns: dict, size: int, names: list[str]) -> pa.RecordBatch:
        kinds = {"key": self.key_type, "groups": pa.string(), "at": pa.binary(), "times": pa.binary(), "kind": pa.int32()}
        arrays = [pa.array(columns[n]) if n in columns else pa.nulls(size, kinds.get(n, pa.int64())) for n in names]
        return pa.RecordBatch.from_arrays(arrays, names=names)


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Stretches of values as 32-bit numbers end to end."""
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [
        None, pa.py_buffer((cuts * 4).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values, "<u4"))]).cast(pa.binary())


def align(df: DataFrame, vocabulary: str, pieces: str, key: str = "doc_id", text: str = "text", groups: str = "sha256",
          chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """(chunk, kind, pair, n, key, n_a, n_b, n_groups, n_links, groups, at, times), in chunks of whole documents.

    Rows of kind 0 are a chunk's distinct pairs (A id times the number of B ids, plus B id) with the number of its
    documents that hold them; rows of kind 1 are documents, one for each row of ``df``: the number of tokens of A and B,
    groups and links, the groups as ``a1,a2|b1;a3|b2`` (``groups="text"``) or their digest, and the places of the
    document's pairs among the chunk's with the links of each, as 32-bit numbers.
    """
    from pyspark import TaskContext

    files = df.sparkSession.sparkContext.broadcast(Tokenizers(vocabulary, pieces))  # of fixed size
    rows = df.select(q(key).alias("key"), q(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    output = (f"chunk long, kind int, pair long, n long, key {kind}, n_a long, n_b long, n_groups long, n_links long, "
              "groups string, at binary, times binary")
    names = [part.split()[0] for part in output.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, aligner, chunk, stretches = TaskContext.get().partitionId(), _Aligner(files.value, groups == "text"), None, _Stretches()
        for batch in sliced(batches, "text", SLICE):
            chunk = chunk or _Chunk(batch.schema.field("key").type)
            data, offsets = utf8(batch.column("text"))
            data = data.tobytes()
            for k, start, end in zip(batch.column("key").to_pylist(), offsets.tolist(), offsets[1:].tolist()):
                document = chunk.new(k)
                if start < end:
                    for some in stretches.add(document, data[start:end].decode("utf-8", "replace")):
                        chunk.add(aligner(some))
                if chunk.size > chunk_links:
                    if stretches.held:
                        chunk.add(aligner(stretches.take()))
                    yield from chunk.batches(task, names)
        if chunk:
            if stretches.held:
                chunk.add(aligner(stretches.take()))
            yield from chunk.batches(task, names)

    return rows.mapInArrow(run, output)


def pair_counts(aligned: DataFrame, n_b_ids: int) -> DataFrame:
    """(pair, documents, best): how many documents hold a pair linked, and whether no other pair of its A id is in more."""
    counts = aligned.where("kind = 0").groupBy("pair").agg(F.sum("n").alias("documents"))
    same = Window.partitionBy(F.col("pair") - F.col("pair") % n_b_ids)  # at most a row for each B id
    return counts.withColumn("best", F.col("documents") == F.max("documents").over(same))


def _apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (chunk, kind, pair): the answers to a chunk, then its documents."""
    chunk, held, answer = None, [], None
    for batch in batches:
        chunks, kinds = batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], (chunks[1:] != chunks[:-1]) | (kinds[1:] != kinds[:-1])))).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(chunks)]):
            if chunks[a] != chunk:
                chunk, held, answer = chunks[a], [], None
            piece = batch.slice(a, b - a)
            if kinds[a] == 0:
                held.append((piece.column("n").to_numpy(), piece.column("best").to_numpy(zero_copy_only=False).astype(bool)))
                continue
            if answer is None:
                answer = [np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int64) for i in (0, 1)]
                held = []
            (at, offsets), (times, _) = utf8(piece.column("at")), utf8(piece.column("times"))
            at, times = (np.frombuffer(x.tobytes(), "<u4").astype(np.int64) for x in (at, times))
            owner = np.repeat(np.arange(piece.num_rows), np.diff(offsets) // 4)
            total = np.concatenate(([0], np.cumsum(times * answer[0][at].astype(np.int64))))[offsets // 4]
            best = np.bincount(owner, times * answer[1][at], piece.num_rows).astype(np.int64)
            columns = [piece.column(n) for n in ("key", "n_a", "n_b", "n_groups", "n_links")] + [pa.array(best), pa.array(np.diff(total)), piece.column("groups")]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])


def scored(df: DataFrame, vocabulary: str, pieces: str, key: str = "doc_id", text: str = "text", groups: str = "sha256",
           chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """One row for each row of ``df``: its key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups.

    ``vocabulary`` is the path of a byte-level tokenizer file (A), ``pieces`` that of a piece model that puts a space
    before texts (B), both read by the driver. A text is compared with a space before it; special tokens are plain
    text. A pair's count is the number of rows of ``df`` that hold it linked: ``n_best`` counts the links whose pair has
    the highest count of its A id, ``count_sum`` adds up the counts of all links. Null and empty texts, and texts that
    either tokenizer does not give back byte by byte (those with U+2581 for one), have zeros and empty groups, and count for
    no pair. Rows of equal keys stay apart; a null key is a key; an empty table gives no row. A text is taken in
    stretches, so memory follows its distinct pairs and its longest run without a space between visible characters.
    """
    import sentencepiece

    n_b_ids = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    aligned = checkpointed(align(df, vocabulary, pieces, key, text, groups, chunk_links), "aligned")
    answers = aligned.where("kind = 0").select("chunk", "kind", "pair").join(pair_counts(aligned, n_b_ids), "pair").withColumnRenamed("documents", "n")
    documents = aligned.where("kind = 1").drop("n")
    chunks = documents.select(F.count_distinct("chunk")).first()[0]
    dealt = documents.unionByName(answers, allowMissingColumns=True).repartition(max(1, -(-chunks // TASK_CHUNKS)), "chunk")
    both = dealt.sortWithinPartitions("chunk", "kind", "pair")
    kind = df.select(q(key)).schema[0].dataType.simpleString()
    found = both.mapInArrow(_apply, f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
    return found.withColumnRenamed("key", key)
