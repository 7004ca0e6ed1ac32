"""Connected components by alternating stars: every round is two aggregations and two joins, and nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on (u, v) with u > v: neighbours are hung on the smallest vertex each centre sees."""
    arcs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = arcs.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.withColumn("m", F.least("u", "m"))
    joined = arcs.join(least, "u")
    if large:  # only neighbours beyond the centre move
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edge list (u, v), where root is the smallest node reachable.

    Each round is written to the checkpoint folder; rounds end when no edge changes, after about the logarithm of the
    longest path. Nodes without an edge do not appear; null ends and loops are ignored.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current, before = checkpointed(pairs, "edges"), None
    while True:
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now[0] == 0 or now == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
        current = checkpointed(_star(_star(current, large=True), large=False), "edges")


def united(first: DataFrame, second: DataFrame) -> DataFrame:
    """``second`` (key, row, component) with the groups of both tables joined: rows are in one if a chain of groups of either leads there.

    ``row`` tells rows apart in both tables, and a component's name is a number of its own table.
    """
    edges = None
    for groups in (first, second):
        members = checkpointed(groups.groupBy("row").agg(F.any_value("component").alias("component")), "members")
        shared = members.groupBy("component").agg(F.min("row").alias("v"), F.count("*").alias("rows")).where("rows > 1")
        # Written out, so that the join has two plain shuffles and a group of very many rows is split.
        found = members.join(checkpointed(shared.drop("rows"), "shared-groups"), "component").select(F.col("row").alias("u"), "v")
        edges = found if edges is None else edges.unionByName(found)
    joined = checkpointed(components(edges), "united")
    return second.join(joined.select(F.col("node").alias("row"), "root"), "row", "left").select(
        *[F.coalesce("root", "row").alias(c) if c == "component" else c for c in second.columns])
