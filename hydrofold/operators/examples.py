"""Example rows: nearest to a target error, samples, masks."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F

from ..schema import q
from ..session import checkpointed
from .ranking import hash_order, smallest_by_hash

IBE_TARGETS = (100.0, 75.0, 50.0, 25.0, 10.0, 5.0)


def nearest_to_target_per_source(df: DataFrame, targets=IBE_TARGETS, n: int = 30, ibe: str = "ibe",
                                 source: str = "Database_name", key: str = "sample_id") -> DataFrame:
    """For every +/- target: the row of each source whose error is closest, then the closest ``n // 2`` sources.

    The least distances of a source are map-side minima of numbers, which need no sorting, so a source with a third of
    all rows is no hot group; only rows at such a distance are compared, and one row per (target, sign, source) is ranked.
    """
    rows = df.where(q(ibe) != 0)
    sign = F.when(q(ibe) > 0, 1).otherwise(-1)
    rows = rows.select(sign.alias("sign"), q(source).alias(source), q(ibe).alias(ibe), q(key).alias(key))
    distance = lambda t: F.abs(q(ibe) - F.lit(float(t)) * F.col("sign"))
    least = checkpointed(rows.groupBy("sign", source).agg(*[F.min(distance(t)).alias(f"_least{i}") for i, t in enumerate(targets)]), "least-distances")
    least = least.withColumnsRenamed({"sign": "_sign", source: "_source"})
    wanted = F.inline(F.filter(F.array(*[F.struct(F.lit(float(t)).alias("target"), distance(t).alias("distance"), F.col(f"_least{i}").alias("_least"))
                                         for i, t in enumerate(targets)]), lambda w: w["distance"] == w["_least"]))
    long = rows.join(least, (F.col("sign") == F.col("_sign")) & q(source).eqNullSafe(F.col("_source"))).select("sign", q(source), q(ibe), q(key), wanted)
    best = long.groupBy("target", "sign", source).agg(F.min(F.struct("distance", q(key), q(ibe))).alias("best")).select(
        "target", "sign", q(source), "best.*")
    order = Window.partitionBy("target", "sign").orderBy("distance", key)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n // 2)


def union_extremes(df: DataFrame, limit: float, ibe: str = "ibe") -> DataFrame:
    """Rows whose error lies beyond ``limit`` to either side, in one pass, with their ``side``."""
    side = F.when(q(ibe) > limit, "high").when(q(ibe) < -limit, "low")
    return df.withColumn("side", side).where(F.col("side").isNotNull())


def sample_n(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Seeded sample of ``n`` rows without replacement; the whole table if it is smaller."""
    return smallest_by_hash(df, key, F.lit(n), seed)


def sample_fraction(df: DataFrame, key: str, parts: int = 10, seed: int = 0) -> DataFrame:
    """Seeded sample of one row in ``parts``, at least one row."""
    return smallest_by_hash(df, key, F.greatest(F.lit(1), F.floor(F.col("total") / parts)), seed)


def mask_list(d: int, cap: int | None = None, seed: int = 42) -> list[tuple[int, int]]:
    """(level, bit mask) for every level 1..d-1: all masks, or ``cap`` of them in seeded random order.

    The list does not depend on the data, so it is made on the driver.
    """
    import hashlib

    masks = []
    for level in range(1, d):
        choices = [sum(1 << i for i in c) for c in combinations(range(d), level)]
        if cap is not None and len(choices) > cap:
            choices = sorted(choices, key=lambda m: hashlib.md5(f"{seed}:{m}".encode()).hexdigest())[:cap]
        masks += [(level, m) for m in sorted(choices)]
    return masks


def mask_table(spark, d: int, cap: int | None = None, seed: int = 42) -> DataFrame:
    """The masks of ``mask_list`` as a table, enumerated and ranked by Spark."""
    every = spark.range(1, (1 << d) - 1).select(F.bit_count("id").cast("int").alias("level"), F.col("id").alias("mask"))
    if cap is None:
        return every
    order = Window.partitionBy("level").orderBy(hash_order(F.col("mask"), seed))
    return every.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= cap).drop("_i")
