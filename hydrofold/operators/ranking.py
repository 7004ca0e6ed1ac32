"""Global order statistics without a single-task sort.

Values are counted per group first, so heavy duplicates cost one row. The counts are then range partitioned into buckets
of about ``bucket_rows`` distinct values, however many that takes; bucket sizes give each bucket's exact offset, and only
rows of one bucket are ranked together. There is one path for every size: a small table is one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import q
from ..session import checkpointed

BUCKET_ROWS = 1_000_000
#: Share of a group's values, as one in so many, by which a sketch may miss a rank.
SKETCH_ACCURACY = 1000
_BUCKET, _BASE = "_bucket", "_base"


def _buckets(rows: int, bucket_rows: int) -> int:
    return max(1, -(-rows // bucket_rows))


def _offsets(df: DataFrame, by: list[str], weight: Column) -> DataFrame:
    """Rows before each bucket and in all buckets of its group; a row per bucket, and one more for each group that begins in it."""
    sizes = df.groupBy(*by, _BUCKET).agg(F.sum(weight).alias("_rows"))
    order = Window.partitionBy(*by).orderBy(_BUCKET)
    whole = Window.partitionBy(*by)
    return sizes.withColumns({
        _BASE: F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_rows"),
        "total": F.sum("_rows").over(whole),
    })


def _counted(df: DataFrame, by: list[str], value: str, bucket_rows: int) -> DataFrame:
    """Distinct values with ``n`` and their bucket, written once so that the buckets stay what they are."""
    counts = checkpointed(df.where(q(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")), "value-counts")
    dealt = counts.repartitionByRange(_buckets(counts.count(), bucket_rows), *[q(c) for c in [*by, value]])
    return checkpointed(dealt.withColumn(_BUCKET, F.spark_partition_id()), "value-buckets")


def _ranked_in_buckets(cut: DataFrame, offsets: DataFrame, by: list[str], value: str, keep_bucket: bool = False) -> DataFrame:
    """``before`` and ``total`` for the values of the buckets that ``offsets`` holds."""
    joined = cut.join(offsets.drop("_rows"), [*by, _BUCKET])
    running = Window.partitionBy(*by, _BUCKET).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.withColumn("before", F.col(_BASE) + F.sum("n").over(running) - F.col("n")).drop(_BASE, *([] if keep_bucket else [_BUCKET]))


def ranked_values(df: DataFrame, by: list[str], value: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Distinct values per group with ``n``, ``before`` (rows with a smaller value) and the group's ``total``.

    The source is scanned once.
    """
    cut = _counted(df, by, value, bucket_rows)
    return _ranked_in_buckets(cut, _offsets(cut, by, F.col("n")), by, value)


def values_at_ranks(df: DataFrame, by: list[str], value: str, ranks: Column, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The order statistics (by, total, rank, value) at 0-based ``ranks``, an array as a function of ``total``.

    Only buckets that hold a wanted rank are sorted at all.
    """
    cut = _counted(df, by, value, bucket_rows)
    inside = lambda r: (r >= F.col(_BASE)) & (r < F.col(_BASE) + F.col("_rows"))
    offsets = _offsets(cut, by, F.col("n")).withColumn("_wanted", F.filter(ranks, inside)).where(F.size("_wanted") > 0)
    ranked = _ranked_in_buckets(cut, offsets.drop("_wanted"), by, value, keep_bucket=True)
    values = ranked.select(*by, _BUCKET, F.col("before").alias("_at"), q(value).cast("double").alias("value"), F.lit(None).cast("long").alias("total"))
    asked = offsets.select(*by, _BUCKET, F.explode("_wanted").alias("_at"), F.lit(None).cast("double").alias("value"), "total")
    # The ranks are sorted in between the values of their bucket and take the last value before them.
    order = Window.partitionBy(*by, _BUCKET).orderBy(F.col("_at"), F.col("value").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (values.unionByName(asked).withColumn("value", F.last("value", True).over(order)).where(F.col("total").isNotNull())
            .select(*by, "total", F.col("_at").alias("rank"), "value"))


def exact_quantiles(df: DataFrame, by: list[str], value: str, probabilities: list[float],
                    output: str = "quantiles", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Linearly interpolated quantiles per group as one array column, plus ``total``.

    The order statistics needed are looked up by rank; no task holds a group's values.
    """
    probs = F.from_json(F.lit(str([float(p) for p in probabilities])), "array<double>")  # folded to one literal
    position = lambda p: (F.col("total") - 1).cast("double") * p
    ranks = F.array_distinct(F.concat(
        F.transform(probs, lambda p: F.floor(position(p))), F.transform(probs, lambda p: F.ceil(position(p)))))
    looked_up = values_at_ranks(df, by, value, ranks, bucket_rows).groupBy(*by).agg(  # twice the probabilities per group
        F.max("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))

    def interpolate(p: Column) -> Column:
        low = F.element_at("_at", F.floor(position(p)))
        high = F.element_at("_at", F.ceil(position(p)))
        return low + (high - low) * (position(p) - F.floor(position(p)))

    return looked_up.select(*by, "total", F.transform(probs, interpolate).alias(output))


def bracketed_quantiles(df: DataFrame, by: list[str], value: str, probabilities: list[float], output: str = "quantiles",
                        accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """``exact_quantiles`` for few groups and few probabilities, in two passes that neither shuffle nor hold all values.

    A sketch gives two values around each wanted one. Then values below such a bracket are only counted, and those inside,
    less than a hundredth, are counted by value and ranked. Where a bracket should miss its rank, all values are ranked.
    """
    known = df.where(q(value).isNotNull()).withColumn("_value", q(value).cast("double"))
    around = [min(1.0, max(0.0, p + side * 2.0 / accuracy)) for p in probabilities for side in (-1, 1)]
    found = known.groupBy(*by).agg(F.count("*").alias("total"), F.percentile_approx("_value", around, accuracy).alias("_edges"),
                                   F.min("_value").alias("_min"), F.max("_value").alias("_max"))
    rows = found.collect()  # a row for each group
    groups = F.broadcast(df.sparkSession.createDataFrame(rows, found.schema))
    edge = lambda i, end: F.col(end) if around[i] in (0.0, 1.0) else F.get("_edges", F.lit(i))
    brackets = F.array(*[F.struct(F.lit(i).alias("_place"), edge(2 * i, "_min").alias("_low"), edge(2 * i + 1, "_max").alias("_high"))
                         for i in range(len(probabilities))])
    met = known.join(groups, by).select(*by, "_value", F.inline(brackets)).where(F.col("_value") <= F.col("_high"))
    counts = met.groupBy(*by, "_place", F.when(F.col("_value") >= F.col("_low"), F.col("_value")).alias("_value")).agg(F.count("*").alias("n"))
    running = Window.partitionBy(*by, "_place").orderBy(F.col("_value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("_end", F.sum("n").over(running)).join(groups, by)
    position = (F.col("total") - 1).cast("double") * F.get(F.array(*[F.lit(float(p)) for p in probabilities]), F.col("_place"))
    at = lambda rank: F.max(F.when((F.col("_end") > rank) & (F.col("_end") - F.col("n") <= rank), F.col("_value")))
    share = F.max(position - F.floor(position))
    ends = placed.groupBy(*by, "_place").agg(at(F.floor(position)).alias("_a"), at(F.ceil(position)).alias("_b"), share.alias("_share"))
    values = ends.collect()  # a row for each group and probability
    if len(values) < len(rows) * len(probabilities) or any(r["_a"] is None or r["_b"] is None for r in values):
        return exact_quantiles(df, by, value, probabilities, output)
    ends = df.sparkSession.createDataFrame(values, ends.schema)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_place", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_share")).alias("v")))), lambda e: e["v"])
    return ends.groupBy(*by).agg(ordered.alias(output)).join(groups.select(*by, "total"), by).select(*by, "total", output)


def average_rank(df: DataFrame, by: list[str], value: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Distinct values with their tie-averaged 1-based rank."""
    ranked = ranked_values(df, by, value, bucket_rows)
    return ranked.withColumn("avg_rank", F.col("before") + (F.col("n") + 1) / 2)


def global_row_number(df: DataFrame, *order: str | Column, output: str = "row_number", start: int = 0,
                      bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Row position in a global order, which must be of distinct keys to be repeatable.

    Rows are range partitioned and sorted once, and written with their place in their partition; the partitions' sizes,
    a row for each, give the offsets.
    """
    n = _buckets(df.count(), bucket_rows)
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({
        _BUCKET: F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    written = checkpointed(placed, "row-places")
    offsets = _offsets(written, [], F.lit(1)).select(_BUCKET, _BASE)
    return (written.join(offsets, _BUCKET).withColumn(output, F.col(_BASE) + F.col("_place") + F.lit(start))
            .drop(_BUCKET, _BASE, "_place"))


def hash_order(key: Column, seed: int) -> Column:
    """Hex text whose order is a seeded random order of the keys, the same in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def smallest_by_hash(df: DataFrame, key: str, n: Column, seed: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The ``n`` rows that come first in the seeded random order; ``n`` may depend on ``total``, the row count.

    Hashes are cut into equal ranges, as many as the count asks for. Whole ranges are below or beyond the cut; the keys of
    the one that holds it are sorted to find the last hash wanted. The rows themselves are only filtered.
    """
    hashed = df.withColumn("_hash", hash_order(q(key), seed))
    total = df.count()
    wanted = df.sparkSession.range(1).select(F.lit(total).alias("total")).select(n.cast("long")).first()[0]
    if wanted >= total or wanted <= 0:  # all of it, or nothing
        return df if wanted > 0 else df.limit(0)
    ranges = _buckets(total, bucket_rows)
    bucket = F.floor(F.conv(F.substring("_hash", 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52)) * ranges).cast("long")
    sizes = {r[_BUCKET]: r["count"] for r in hashed.groupBy(bucket.alias(_BUCKET)).count().collect()}  # a row per range
    before, cut = 0, 0
    for cut in sorted(sizes):
        if before + sizes[cut] >= wanted:
            break
        before += sizes[cut]
    last = hashed.where(bucket == cut).select("_hash", q(key).alias("_key")).orderBy("_hash", "_key").limit(wanted - before).agg(
        F.max(F.struct("_hash", "_key")).alias("last")).first()["last"]
    return hashed.where((bucket < cut) | (F.col("_hash") < last["_hash"]) | (
        (F.col("_hash") == last["_hash"]) & (q(key) <= F.lit(last["_key"])))).drop("_hash")
