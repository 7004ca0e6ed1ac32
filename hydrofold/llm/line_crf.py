"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's features describe it and its two neighbours; forward-backward marginals of the lines, weighted by their
length, add up to the quality of the document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..schema import q
from .texts import sliced, utf8

SLICE = 1 << 20
#: At most this many labelled documents are fitted on; a larger table is sampled by a hash of the key.
SAMPLE_DOCUMENTS = 6_000
#: Of rows that share a key so many may be in the sample.
SAMPLE_ROWS = 4
#: A sampled document of more lines is fitted on a run of so many neighbouring ones, at a place that a hash of it names.
SAMPLE_LINES = 200
ROUNDS = 150
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>^~@{}[]\\=_+"))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_POINT = np.isin(np.arange(256), list(b".,;:'\"()-"))
_BANG = np.isin(np.arange(256), list(b"!?"))
_WIDE = np.arange(256) >= 128
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
OWN = 14
FEATURES = 3 * OWN + 1


def _line_features(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """What describes each line [low, high) by itself; the lines lie one after another."""
    def per_line(marks: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
        return (sums[high] - sums[low]).astype(float)

    blank = _BLANK[data]
    begins = ~blank
    begins[1:] &= blank[:-1]
    begins[low[low < high]] = ~blank[low[low < high]]
    start = np.flatnonzero(begins)
    line = np.searchsorted(low, start, side="right") - 1
    stops = np.flatnonzero(~blank & np.concatenate((blank[1:], [True])))
    inner_end = high[low < high] - 1
    stops = np.union1d(stops, inner_end[~blank[inner_end]]) + 1
    words = np.bincount(line, minlength=len(low)).astype(float)
    base = np.uint64(0x9E3779B97F4A7C15)
    powers = np.multiply.accumulate(np.full(len(data) + 1, base))
    inverse = np.multiply.accumulate(np.full(len(data) + 1, np.uint64(pow(int(base), -1, 1 << 64))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1])))
    code = (sums[stops] - sums[start]) * inverse[start]
    code ^= code >> np.uint64(31)
    again = np.zeros(len(start), bool)
    again[1:] = (code[1:] == code[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((code, line))
    twice = np.zeros(len(start), bool)
    twice[order[1:]] = (code[order[1:]] == code[order[:-1]]) & (line[order[1:]] == line[order[:-1]])
    length = (high - low).astype(float)
    size, count = np.maximum(length, 1), np.maximum(words, 1)
    letters = np.maximum(per_line(~blank), 1)
    last = np.where(low < high, data[np.maximum(high - 1, 0)] if len(data) else 0, 0)
    return np.column_stack((
        np.log1p(length) / 8, np.log1p(words) / 5, letters / count / 10, per_line(_UPPER[data]) / letters, per_line(_DIGIT[data]) / letters,
        np.minimum(per_line(_SYMBOLS[data]) / count, 3), np.minimum(per_line(_BANG[data]) / count, 3), per_line(_POINT[data]) / count,
        per_line(_WIDE[data]) / letters, np.bincount(line, again, len(low)) / count, np.bincount(line, twice, len(low)) / count,
        last == 46, per_line(blank) / size, words == 0)).astype(float)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line features with those of the neighbours and a constant, line lengths, and the line offsets of the texts.

    Lines end at line feeds; every text has at least one line, which for an empty text is empty.
    """
    feeds = np.flatnonzero(data == 10)
    low = np.sort(np.concatenate((offsets[:-1], feeds + 1)), kind="stable")
    text = np.sort(np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, feeds, side="right") - 1)), kind="stable")
    first = np.searchsorted(text, np.arange(len(offsets)))
    is_last = np.zeros(len(low), bool)
    is_last[first[1:] - 1] = True
    high = np.empty(len(low), np.int64)
    high[is_last] = offsets[1:]
    high[~is_last] = low[1:][~is_last[:-1]] - 1
    own = _line_features(data, low, high)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1]
    after[:-1] = own[1:]
    before[first[:-1]] = own[first[:-1]]  # an edge line stands for its missing neighbour
    after[is_last] = own[is_last]
    return np.column_stack((own, before, after, np.ones(len(own)))), (high - low).astype(float), first


def _lockstep(first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The chains by falling length, and for each step the chains that reach it."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    ended = np.searchsorted(-sizes[order], -np.arange(1, sizes.max() + 1), side="right")
    return order, [order[:n] for n in ended]


def marginals(state: np.ndarray, move: np.ndarray, first: np.ndarray, pairs: bool = False):
    """Posterior of good for every line, and with ``pairs`` the log normaliser and the expected moves of all chains.

    ``state`` are log scores (lines x 2) and ``move`` those of neighbouring labels; chains advance together.
    """
    n = len(state)
    ahead, back = np.empty((n, 2)), np.zeros((n, 2))
    _, steps = _lockstep(first)
    for t, chains in enumerate(steps):
        at = first[chains] + t
        ahead[at] = state[at] if t == 0 else state[at] + np.logaddexp(
            ahead[at - 1][:, :1] + move[0], ahead[at - 1][:, 1:] + move[1])
    last = first[1:] - 1
    sizes = np.diff(first)
    for t in range(len(steps) - 1, 0, -1):
        at = first[steps[t]] + t
        message = state[at] + back[at]
        back[at - 1] = np.logaddexp(message[:, :1] + move[:, 0], message[:, 1:] + move[:, 1])
    total = np.logaddexp(ahead[last, 0], ahead[last, 1])
    norm = np.repeat(total, sizes)
    good = np.exp(ahead[:, 1] + back[:, 1] - norm)
    if not pairs:
        return good
    inner = np.ones(n, bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    joint = ahead[at - 1][:, :, None] + move + (state[at] + back[at])[:, None, :] - norm[at, None, None]
    return good, total, np.exp(joint).sum(axis=0)


@dataclass
class Model:
    """Weights of the features for a good line, log scores of neighbouring labels, and a final scale and shift."""

    weights: np.ndarray
    move: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        lines, lengths, first = features(data, offsets)
        if not len(lines):
            return np.zeros(0)
        evidence = lines @ self.weights
        good = marginals(np.column_stack((np.zeros(len(evidence)), evidence)), self.move, first)
        weight = lengths + 1  # so that an empty text has a score too
        raw = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
        logit = np.log(np.clip(raw, 1e-6, 1 - 1e-6)) - np.log1p(-np.clip(raw, 1e-6, 1 - 1e-6))
        return 1 / (1 + np.exp(-(self.scale * logit + self.shift)))


def fit(lines: np.ndarray, first: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights that maximise the penalised likelihood of chains whose lines all carry their document's label."""
    y = np.repeat(labels, np.diff(first)).astype(float)
    chains = len(labels)
    theta, m, v = np.zeros(lines.shape[1] + 4), 0.0, 0.0
    seen = np.array([[0.0, 0.0], [0.0, 0.0]])
    steps = np.diff(first) - 1
    seen[0, 0], seen[1, 1] = steps[labels == 0].sum(), steps[labels == 1].sum()
    for t in range(1, rounds + 1):
        weights, move = theta[:-4], theta[-4:].reshape(2, 2)
        evidence = lines @ weights
        good, _, moves = marginals(np.column_stack((np.zeros(len(y)), evidence)), move, first, pairs=True)
        slope = np.concatenate((lines.T @ (y - good), (seen - moves).ravel())) / chains - ridge * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope ** 2
        theta = theta + 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def train(df: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id",
          most: int = SAMPLE_DOCUMENTS, seed: int = 5) -> Model:
    """A model from the texts of ``df`` whose ``key`` has label 0 or 1 in ``labels``, on a sample of about ``most`` of them.

    The keys are sampled by their hash before any text is read, so texts are not shuffled. Each label gives half the
    sample where it can. A key that is labelled repeatedly counts once; null keys and keys with both labels take no part.
    One in four of the sampled documents is kept out of the fit and sets the scale and shift that make scores agree with
    the label's frequency. With one label only every score is that label; without labels, or without texts to them, a half.
    """
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("key")), F.lit(1 << 30))
    rows = labels.where(q(label).isin(0, 1) & q(key).isNotNull()).groupBy(q(key).alias("key")).agg(
        F.min(q(label)).cast("int").alias("label"), F.max(q(label)).cast("int").alias("other")).where("label = other").select("key", "label", place.alias("place"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    none = np.zeros(FEATURES), np.zeros((2, 2))
    if len(sizes) < 2:
        return Model(*none, 0.0, {0: -20.0, 1: 20.0}.get(next(iter(sizes), None), 0.0))
    cut = F.when(F.col("label") == 1, int((1 << 30) * min(1.0, most / 2 / sizes[1]))).otherwise(int((1 << 30) * min(1.0, most / 2 / sizes[0])))
    chosen = rows.where(F.col("place") < cut).orderBy("place", "key").limit(most)  # each key once, so the bound holds
    texts = df.select(q(key).alias("key"), F.coalesce(q(text), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "key").select("key", "label", "place", F.xxhash64("text").alias("tie"), "text")
    fields = sample.drop("text").schema

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            lines, lengths, first = features(*utf8(batch.column("text")))
            tie = batch.column("tie").to_numpy()
            spare = np.maximum(np.diff(first) - SAMPLE_LINES, 0)
            begin = first[:-1] + np.abs(tie % (spare + 1))
            runs = list(zip(begin.tolist(), (begin + np.minimum(np.diff(first), SAMPLE_LINES)).tolist()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in fields), pa.array([lines[a:b].astype(np.float32).tobytes() for a, b in runs], pa.binary()),
                 pa.array([lengths[a:b].tolist() for a, b in runs])], names=[*fields.names, "lines", "lengths"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    described = sample.mapInArrow(describe, f"{kind}, lines binary, lengths array<double>")
    first_rows = F.row_number().over(Window.partitionBy("key").orderBy("tie"))  # a few rows of a key leave each task
    bounded = described.withColumn("row", first_rows).where(F.col("row") <= SAMPLE_ROWS).orderBy("place", "tie").limit(most)
    found = bounded.select("label", "place", "tie", "lines", "lengths").toPandas()
    found = found.sort_values(["place", "label", "tie"], kind="stable").reset_index(drop=True)
    if found["label"].nunique() < 2:
        return Model(*none, 0.0, {0: -20.0, 1: 20.0}.get(found["label"].iloc[0]) if len(found) else 0.0)
    held = np.arange(len(found)) % 4 == 3
    labels = found["label"].to_numpy()

    def chains(part):
        blocks = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in part["lines"]]
        return np.concatenate(blocks).astype(float), np.concatenate(([0], np.cumsum([len(b) for b in blocks])))

    if not all(len(set(labels[part])) == 2 for part in (held, ~held)):
        held[:] = False
    model = Model(*fit(*chains(found[~held]), labels[~held]))
    if held.any():
        lines, first = chains(found[held])
        good = marginals(np.column_stack((np.zeros(len(lines)), lines @ model.weights)), model.move, first)
        weight = np.concatenate([np.asarray(x) for x in found["lengths"][held]]) + 1
        raw = np.clip(np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]), 1e-6, 1 - 1e-6)
        share = sizes[1] / (sizes[0] + sizes[1])
        odds = np.where(labels[held] == 1, share / (labels[held] == 1).mean(), (1 - share) / (labels[held] == 0).mean())
        model.scale, model.shift = _calibrated(np.log(raw / (1 - raw)), labels[held], odds)
    return model


def _calibrated(logit: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve, by Newton's steps with a small ridge."""
    theta, x = np.array([1.0, 0.0]), np.column_stack((logit, np.ones(len(logit))))
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ theta)))
        slope = x.T @ (weight * (labels - p)) - 0.1 * (theta - [1.0, 0.0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        theta = theta + np.clip(np.linalg.solve(curve, slope), -1, 1)
    return max(float(theta[0]), 0.0), float(theta[1])


def score(df: DataFrame, model: Model, text: str = "text", output: str = "score") -> DataFrame:
    """``df`` plus the quality of ``text`` between 0 and 1; null counts as an empty text, which has one empty line."""
    fields = [f for f in df.schema.fields if f.name != output]
    schema = df.select(*(q(f.name) for f in fields)).schema.add(output, "double")
    shared = df.sparkSession.sparkContext.broadcast(model)  # some dozen numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, SLICE):
            columns = [batch.column(f.name) for f in fields] + [pa.array(shared.value.scores(*utf8(batch.column(text))))]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in fields), output])

    return df.mapInArrow(run, schema)
