"""Language identification: scripts narrow the candidates, and Viterbi over per-word scores labels spans.

Words are scored by their letter trigrams, whose counts are learned per language over all labelled texts. A path may
change its language between words at a penalty, which marks the spans of mixed texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .texts import sliced

BUCKETS = 1 << 15
SLICE = 1 << 20
STRETCH = 128
# First code points of the ranges in which scripts lie; a range ends where the next one begins.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Asian"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"),
    (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFF21, "Latin"), (0xFF66, "Kana"), (0x10000, "Other"), (0x20000, "Han"),
]
NAMES = sorted({name for _, name in SCRIPTS})


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For code points below 0x10000: the script of letters (0: no letter) and the lower-case code point."""
    script = np.zeros(0x10000, np.uint8)
    lower = np.arange(0x10000, dtype=np.uint32)
    firsts = [first for first, _ in SCRIPTS]
    for code in range(0x10000):
        c = chr(code)
        if unicodedata.category(c)[0] == "L":
            script[code] = 1 + NAMES.index(SCRIPTS[int(np.searchsorted(firsts, code, side="right")) - 1][1])
            if len(c.lower()) == 1:
                lower[code] = min(ord(c.lower()), 0xFFFF)
    return script, lower


class Words:
    """The words (runs of letters) of many texts end to end, with the trigram buckets of their letters."""

    def __init__(self, texts: list[str], tables: tuple[np.ndarray, np.ndarray]):
        script_of, lower = tables
        codes = np.frombuffer("\n".join(texts + [""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        high = codes > 0xFFFF
        low = np.where(high, 0, codes)
        script = script_of[low]
        letters = lower[low].astype(np.uint64)
        if high.any():  # rare letters beyond the basic plane
            for code in np.unique(codes[high]).tolist():
                if unicodedata.category(chr(code))[0] == "L":
                    script[codes == code] = 1 + NAMES.index("Han" if code >= 0x20000 else "Other")
                    letters[codes == code] = code
        letters[script == 0] = 0
        around = np.concatenate((np.zeros(1, np.uint64), letters, np.zeros(1, np.uint64)))
        at = np.flatnonzero(script)
        key = (around[at] << np.uint64(42)) ^ (around[at + 1] << np.uint64(21)) ^ around[at + 2]
        key *= np.uint64(0x9E3779B97F4A7C15)
        self.bucket = (key >> np.uint64(49)).astype(np.int64)
        self.script = script[at]
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1] + 1
        self.first = np.flatnonzero(new)  # of each word, among the letters
        self.letters = np.diff(np.append(self.first, len(at)))
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.begin = at[self.first]
        self.text = np.searchsorted(ends, self.begin, side="right")
        self.begin = self.begin - (ends - [len(t) + 1 for t in texts])[self.text]


@dataclass
class Model:
    """Languages, log scores of trigram buckets (buckets x languages), scripts each language uses, and the common one."""

    languages: list[str]
    scores: np.ndarray
    uses: np.ndarray
    common: int


def train(df: DataFrame, text: str = "text", language: str = "lang", rare: float = 0.001) -> Model:
    """Counts trigram buckets and scripts of all rows with a language; null texts add nothing.

    The counts are summed by Spark; what reaches the driver is at most buckets x languages. A script counts as used by a
    language if at least ``rare`` of its letters are of it.
    """
    rows = df.where(F.col(language).isNotNull()).select(F.col(text).alias("text"), F.col(language).cast("string").alias("lang"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, counts = _tables(), {}
        for batch in sliced(batches, "text", SLICE):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            langs = np.array(batch.column("lang").to_pylist(), object)
            words = Words(texts, tables)
            owner = np.repeat(words.text, words.letters)
            for lang in set(langs.tolist()):
                mine = (langs == lang)[owner]
                held = counts.setdefault(lang, np.zeros(BUCKETS + 256, np.int64))
                held[:BUCKETS] += np.bincount(words.bucket[mine], minlength=BUCKETS)
                held[BUCKETS:] += np.bincount(words.script[mine], minlength=256)
        for lang, held in counts.items():
            place = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(place), pa.string()), pa.array(place), pa.array(held[place])],
                                             names=["lang", "place", "n"])

    found = rows.mapInArrow(run, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    names = found["lang"].to_pylist()
    languages = sorted(set(names))
    counts = np.zeros((BUCKETS + 256, max(1, len(languages))))
    if languages:
        counts[found["place"].to_numpy(), np.searchsorted(languages, names)] = found["n"].to_numpy()
    seen = counts[:BUCKETS]
    scores = np.log((seen + 0.1) / (seen.sum(axis=0) + 0.1 * BUCKETS)).astype(np.float32)
    scripts = counts[BUCKETS:]
    uses = scripts >= np.maximum(rare * scripts.sum(axis=0), 1)
    return Model(languages, scores, uses, int(seen.sum(axis=0).argmax()))


def best_path(scores: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """The best language of each word: sums of ``scores`` less ``penalty[i]`` where word i changes the language.

    The words are cut into stretches that advance together, each from every language it may be entered with; the
    stretches are then chained, and the path is read back. No language of a word may be excluded for all.
    """
    n, k = scores.shape
    m = -(-n // STRETCH)
    padded = np.zeros((m * STRETCH, k))
    padded[:n] = scores
    cost = np.zeros(m * STRETCH)
    cost[:n] = penalty
    padded, cost = padded.reshape(m, STRETCH, k), cost.reshape(m, STRETCH)
    value = np.full((m, k, k), -1e18)  # stretch, language before it, language at the word
    value[:, np.arange(k), np.arange(k)] = 0
    best = np.empty((STRETCH, m, k), np.int16)
    moved = np.empty((STRETCH, m, k, k), bool)
    for t in range(STRETCH):
        best[t] = value.argmax(axis=2)
        top = np.take_along_axis(value, best[t][:, :, None].astype(np.int64), 2) - cost[:, t, None, None]
        moved[t] = top > value
        value = np.maximum(value, top) + padded[:, t, None, :]
    total, entered = np.zeros(k), np.empty((m, k), np.int64)
    for i in range(m):
        through = total[:, None] + value[i]
        entered[i] = through.argmax(axis=0)
        total = through.max(axis=0)
        total -= total.max()
    last, first = np.empty(m, np.int64), np.empty(m, np.int64)
    state = int(total.argmax())
    for i in range(m - 1, -1, -1):
        last[i], first[i] = state, entered[i, state]
        state = first[i]
    path, rows, state = np.empty((m, STRETCH), np.int64), np.arange(m), last
    for t in range(STRETCH - 1, -1, -1):
        path[:, t] = state
        state = np.where(moved[t][rows, first, state], best[t][rows, first], state)
    return path.ravel()[:n]


def label(df: DataFrame, model: Model, text: str = "text", language: str = "lang_pred", score: str = "score",
          spans: str = "spans", penalty: float = 12.0) -> DataFrame:
    """``df`` plus the predicted language of ``text``, the share of letters labelled with it, and the labelled spans.

    ``spans`` are (start, end, lang) in code points, from the first to the last letter of neighbouring words with one
    language. A word's candidates are the languages that use its script; a script that none uses leaves all of them.
    Texts that are null or have no letter, and any text if no language was learned, are ``und`` with score zero and no span.
    """
    fields = [f for f in df.schema.fields if f.name not in (language, score, spans)]
    schema = df.select(*(f"`{f.name}`" for f in fields)).schema.add(language, "string").add(score, "double").add(
        spans, T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("lang", "string")))
    shared = df.sparkSession.sparkContext.broadcast(model)  # buckets x languages

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tables = shared.value, _tables()
        allowed = model.uses.copy()
        allowed[~allowed.any(axis=1)] = True
        k = len(model.languages)
        names = np.array([*model.languages, "und"], object)
        for batch in sliced(batches, text, SLICE):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            words = Words(texts, tables)
            chosen, share = np.full(len(texts), k), np.zeros(len(texts))
            if k and len(words.first):
                scores = np.add.reduceat(model.scores[words.bucket], words.first, axis=0, dtype=np.float64)
                scores[~allowed[words.script[words.first]]] -= 1e6  # excluded unless nothing else is left
                new = np.concatenate(([True], words.text[1:] != words.text[:-1]))
                path = best_path(scores, np.where(new, 0.0, penalty))
                sums = np.bincount(words.text * k + path, words.letters, len(texts) * k).reshape(-1, k)
                full = sums.any(axis=1)
                chosen[full] = sums[full].argmax(axis=1)
                share[full] = sums[full].max(axis=1) / sums[full].sum(axis=1)
                cut = np.flatnonzero(new | np.concatenate(([True], path[1:] != path[:-1])))
                end = np.append(cut[1:], len(path)) - 1
                parts = pa.StructArray.from_arrays(
                    [pa.array(words.begin[cut].astype(np.int32)), pa.array((words.begin[end] + words.letters[end]).astype(np.int32)),
                     pa.array(names[path[cut]], pa.string())], names=["start", "end", "lang"])
                offsets = np.searchsorted(words.text[cut], np.arange(len(texts) + 1))
            else:
                parts = pa.array([], pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                offsets = np.zeros(len(texts) + 1, np.int64)
            columns = [batch.column(f.name) for f in fields]
            columns += [pa.array(names[chosen], pa.string()), pa.array(share), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), parts)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in fields), language, score, spans])

    return df.mapInArrow(run, schema)
