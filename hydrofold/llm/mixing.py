"""Mixing sources to target weights by Poisson replication: every document is repeated a hash-seeded Poisson number of times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import q
from ..session import checkpointed
from .texts import fresh

#: A larger rate is drawn as a sum of that many independent parts, so that exp(-rate) stays a normal number.
PART_RATE = 500.0


def uniform(key: Column, seed: int, part: Column) -> Column:
    """A number in [0, 1) of 52 bits from a digest of seed, key and part; the same in any engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), part.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(df: DataFrame, source: str, weights: dict[str, float] | None, epochs: float) -> DataFrame:
    """(source, n, rate) with the mean number of copies that takes each source to its weight.

    Sources without a weight share what the given weights leave over, equally; without any weights all are equal.
    A null source is a source of its own. The mixture has ``epochs`` times the rows of ``df`` on average.
    """
    given = F.create_map(*(x for k, v in (weights or {}).items() for x in (F.lit(k), F.lit(float(v))))) if weights else None
    counts = checkpointed(df.groupBy(q(source).alias("source")).agg(F.count("*").alias("n")), "sources")
    weight = F.element_at(given, F.coalesce("source", F.lit(""))) if given is not None else F.lit(None).cast("double")
    known = counts.withColumn("weight", weight)
    total = known.agg(F.sum("n").alias("total"), F.count(F.when(F.col("weight").isNull(), 1)).alias("rest"),
                      F.coalesce(F.sum("weight"), F.lit(0.0)).alias("taken"))
    share = F.coalesce("weight", F.greatest(F.lit(0.0), 1.0 - F.col("taken")) / F.col("rest"))
    return known.crossJoin(F.broadcast(total)).select(  # one row
        "source", "n", (F.lit(float(epochs)) * share * F.col("total") / F.col("n")).alias("rate"))


def _cumulative(rate: Column) -> Column:
    """Poisson probabilities of at most 0, 1, 2, ... up to where a number of 52 bits cannot reach."""
    steps = F.sequence(F.lit(1), (rate + 12.0 * F.sqrt(rate) + 30.0).cast("int"))
    start = F.struct(F.exp(-rate).alias("term"), F.array(F.exp(-rate)).alias("sums"))

    def step(state: Column, k: Column) -> Column:
        term = state["term"] * rate / k
        return F.struct(term.alias("term"), F.concat(state["sums"], F.array(F.element_at(state["sums"], -1) + term)).alias("sums"))

    return F.aggregate(steps, start, step)["sums"]


def mix(df: DataFrame, source: str = "source", key: str = "doc_id", weights: dict[str, float] | None = None,
        epochs: float = 1.0, seed: int = 7, copy: str = "copy", order: str = "shuffle_key") -> DataFrame:
    """Each row of ``df`` as often as its Poisson draw says, with its ``copy`` number from 1, in a random global order.

    The draw inverts the Poisson distribution of the row's source rate at a uniform number hashed from seed and key:
    the result does not depend on partitions or retries, and rows of equal keys are drawn alike (null is one key). The
    order is that of ``order``, a digest of seed, key and copy: rows are dealt to partitions by it and sorted within
    them. An empty table stays empty; columns of ``df`` called ``copy`` or ``order`` are replaced.
    """
    df = df.drop(copy, order)
    rate, sums, parts, at = (fresh(df, name) for name in ("_rate", "_sums", "_parts", "_source"))
    n_parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE).cast("int"))
    table = checkpointed(rates(df, source, weights, epochs).select(F.col("source").alias(at), n_parts.alias(parts), _cumulative(
        F.col("rate") / n_parts).alias(sums), F.col("rate").alias(rate)), "rates")
    drawn = df.join(table, df[source].eqNullSafe(table[at]))

    def below(part: Column) -> Column:
        number = uniform(q(key), seed, part)
        return F.aggregate(F.array(number), F.lit(0), lambda _, u: F.size(F.filter(sums, lambda s: s <= u)))

    copies = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda total, part: total + below(part))
    exploded = (drawn.withColumn(copy, copies).where(q(copy) > 0)
                .withColumn(copy, F.explode(F.sequence(F.lit(1), q(copy)))).drop(rate, sums, parts, at))
    digest = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(q(key).cast("string"), F.lit("")), F.lit("/"), q(copy).cast("string")))
    return exploded.withColumn(order, digest).repartition(order).sortWithinPartitions(order)
