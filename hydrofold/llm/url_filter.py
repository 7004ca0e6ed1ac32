"""URL filter: rules of hosts and paths, and for all other URLs the likelihood ratio of two character models.

Both models are Markov chains of variable order over bytes: the prediction after a long context leans on that after the
shorter one, the more so the fewer times the context was seen. One is learned from the URLs that rules accept, one from
those they reject. The difference of log likelihoods per byte is cut where it separates held-back ruled URLs best.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..schema import q
from .texts import ascii_lower, fresh, sliced, utf8

ORDER = 5
CONTEXTS = 1 << 13
PAIRS = 1 << 16
SLOTS = (ORDER + 1) * (CONTEXTS + PAIRS)
TRUST = 4.0
FOLDS = 5
BINS_PER_UNIT = 50
WIDEST = 10
SLICE = 1 << 20


@dataclass(frozen=True)
class Rule:
    """Fits its host with all subdomains if the path begins with the rule's path; text is host and path."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host):]


def with_address(df: DataFrame, url: str = "url", host: str = "host", path: str = "path", rest: str = "rest") -> DataFrame:
    """``df`` plus host (A-Z lower-cased), path, and all that follows ``://`` with that host; empty if there is none."""
    after = F.expr(f"CASE WHEN instr(`{url}`, '://') > 0 THEN substring(`{url}`, instr(`{url}`, '://') + 3) ELSE '' END")
    raw = F.regexp_extract(after, r"^([^/?#]*)", 1)
    return df.withColumns({
        host: ascii_lower(raw), path: F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1),
        rest: F.concat(ascii_lower(raw), F.regexp_extract(after, r"^[^/?#]*((?s:.*))$", 1))})


def fitting(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits as (rule, verdict), null if none does; compiled into one conditional."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte (and each URL's end) the counter of its context and of context and byte, per order."""
    n, count = len(data), len(offsets) - 1
    codes = np.full(n + count * (ORDER + 1), 256, np.uint64)  # each URL has ORDER marks before it and one after it
    own = np.arange(n) + np.repeat(np.arange(count) * (ORDER + 1) + ORDER, np.diff(offsets))
    codes[own] = data
    judged = np.ones(len(codes), bool)
    starts = offsets[:-1] + np.arange(count) * (ORDER + 1)
    for i in range(ORDER):
        judged[starts + i] = False
    at = np.flatnonzero(judged)
    context, contexts, pairs = np.zeros(len(at), np.uint64), [], []
    for order in range(ORDER + 1):
        if order:
            context = (context + codes[at - order] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            context ^= context >> np.uint64(29)
        pair = (context + codes[at] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        pair ^= pair >> np.uint64(32)
        contexts.append((context % np.uint64(CONTEXTS)).astype(np.int64) + order * CONTEXTS)
        pairs.append((pair % np.uint64(PAIRS)).astype(np.int64) + (ORDER + 1) * CONTEXTS + order * PAIRS)
    return np.array(contexts), np.array(pairs)


@dataclass
class Model:
    """Counters of both models (rejected, accepted) and the cut of the difference per byte."""

    counts: np.ndarray
    cut: float = 0.0

    def difference(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Accepted less rejected log likelihood per byte of each URL; zero for an empty one or an unlearned model."""
        if not len(offsets) - 1 or not self.counts.any(axis=1).all():
            return np.zeros(len(offsets) - 1)
        contexts, pairs = _slots(data, offsets)
        total = np.zeros(contexts.shape[1])
        for counts, sign in zip(self.counts, (-1.0, 1.0)):
            chance = np.full(contexts.shape[1], 1 / 257)
            for c, p in zip(contexts, pairs):
                chance = (counts[p] + TRUST * chance) / (counts[c] + TRUST)
            total += sign * np.log(chance)
        lengths = np.diff(offsets)
        summed = np.add.reduceat(total, offsets[:-1] + np.arange(len(lengths)))
        return np.where(lengths > 0, summed / (lengths + 1), 0.0)


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(FOLDS))


def train(df: DataFrame, rest: str, verdict: str) -> Model:
    """Both models from all rows with a verdict, but for one fold of URLs that calibrates the cut.

    The counters are hashed into a fixed number of slots and summed by Spark, so the model's size does not depend on the
    data; neither does that of the histogram from which the cut is taken: the difference at which the shares of accepted
    URLs above and of rejected URLs below are largest together, the middle one among equals.
    """
    rows = df.where(q(verdict).isNotNull()).select(
        q(rest).alias("rest"), (q(verdict) == "allow").cast("int").alias("kind"), _fold(q(rest)).alias("fold"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, SLOTS), np.int64)
        for batch in sliced(batches, "rest", SLICE):
            data, offsets = utf8(batch.column("rest"))
            contexts, pairs = _slots(data, offsets)
            kinds = np.repeat(batch.column("kind").to_numpy(), np.diff(offsets) + 1)
            for kind in (0, 1):
                held[kind] += np.bincount(contexts[:, kinds == kind].ravel(), minlength=SLOTS)
                held[kind] += np.bincount(pairs[:, kinds == kind].ravel(), minlength=SLOTS)
        for kind in (0, 1):
            slot = np.flatnonzero(held[kind])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), kind, np.int32)), pa.array(slot), pa.array(held[kind][slot])],
                                             names=["kind", "slot", "n"])

    sums = rows.where("fold <> 0").select("rest", "kind").mapInArrow(count, "kind int, slot long, n long").groupBy("kind", "slot").agg(
        F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, SLOTS), np.float32)
    counts[sums["kind"].to_numpy(), sums["slot"].to_numpy()] = sums["n"].to_numpy()
    model = Model(counts)
    bins = F.greatest(F.lit(-WIDEST * BINS_PER_UNIT), F.least(F.lit(WIDEST * BINS_PER_UNIT), F.floor(F.col("llr") * BINS_PER_UNIT)))
    found = with_difference(rows.where("fold = 0"), model, "rest", "llr").groupBy("kind", bins.alias("bin")).count().collect()  # 2 x 1001 rows
    shares = np.zeros((2, 2 * WIDEST * BINS_PER_UNIT + 1))
    for row in found:
        shares[row["kind"], row["bin"] + WIDEST * BINS_PER_UNIT] = row["count"]
    if shares.any(axis=1).all():
        shares /= shares.sum(axis=1, keepdims=True)
        apart = np.append(0, np.cumsum(shares[0])) + np.append(np.cumsum(shares[1][::-1])[::-1], 0)
        best = np.flatnonzero(apart >= apart.max() - 1e-12)
        model.cut = (int(best[len(best) // 2]) - WIDEST * BINS_PER_UNIT) / BINS_PER_UNIT
    return model


def with_difference(df: DataFrame, model: Model, rest: str, output: str) -> DataFrame:
    """``df`` plus the models' difference per byte."""
    fields = [f for f in df.schema.fields if f.name != output]
    schema = df.select(*(q(f.name) for f in fields)).schema.add(output, "double")
    shared = df.sparkSession.sparkContext.broadcast(model)  # a fixed number of slots

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rest, SLICE):
            columns = [batch.column(f.name) for f in fields] + [pa.array(shared.value.difference(*utf8(batch.column(rest))))]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in fields), output])

    return df.mapInArrow(run, schema)


def judged(df: DataFrame, rules: list[Rule], url: str = "url", llr: str = "llr") -> DataFrame:
    """``df`` plus host, path, rule, llr and verdict (allow or block); such columns of ``df`` are replaced.

    A rule decides where one fits. Elsewhere a URL is blocked if its difference is below the calibrated cut; a null URL
    or one without ``://`` has no byte, so its difference is zero and it is allowed.
    """
    df = df.drop("host", "path", "rule", llr, "verdict")
    rest, told_by, known = (fresh(df, name) for name in ("_rest", "_chosen", "_ruled"))
    ruled = with_address(df, url, rest=rest).withColumn(told_by, fitting(rules, F.col("host"), F.col("path")))
    ruled = ruled.withColumns({"rule": F.col(told_by)["rule"], known: F.col(told_by)["verdict"]}).drop(told_by)
    model = train(ruled, rest, known)
    told = F.when((q(llr) < model.cut) & (q(rest) != ""), "block").otherwise("allow")
    return with_difference(ruled, model, rest, llr).withColumn("verdict", F.coalesce(known, told)).drop(known, rest)
