"""Sharding on the ring against a walk of single rows."""

from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from hydrofold.llm import ring


def brute(cells, owner, room):
    """Rows (given by their cells, in order) walk clockwise one by one: a cell's own rows first, then those passing by."""
    waiting, used, where = deque(), Counter(), {}
    for lap in range(2):
        for cell, shard in enumerate(owner):
            mine = [i for i, c in enumerate(cells) if c == cell] if lap == 0 else []
            for queue in (deque(mine), waiting):
                while queue and used[shard] < room[shard]:
                    where[queue.popleft()] = (shard, used[shard])
                    used[shard] += 1
                if queue is not waiting:
                    late = queue
            waiting.extend(late)
    return where


@pytest.mark.parametrize("slack,per_task", [(0.0, 250_000), (0.1, 250_000), (0.0, 7), (0.3, 7)])
def test_rows_equal_single_steps(spark, slack, per_task):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("shard"), F.lit(3).alias("_cell"))
    placed = ring.place(df, 5, virtual_nodes=8, cell_bits=8, slack=slack, rows_per_task=per_task).collect()
    cell = {r["doc_id"]: r["c"] for r in df.select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(0), F.col("doc_id").cast("string")), 56).alias("c")).collect()}
    owner, room = ring.owners(5, 8, 8), ring.rooms(3000, 5, slack)
    where = brute(sorted(cell.values()), owner, room)
    counted = Counter(r["shard"] for r in placed)
    assert Counter(s for s, _ in where.values()) == counted and max(counted.values()) <= max(room)
    assert Counter((c, s) for c, (s, _) in zip(sorted(cell.values()), (where[i] for i in range(3000)))) == Counter((cell[r["doc_id"]], r["shard"]) for r in placed)
    for shard in range(5):
        assert sorted(r["slot"] for r in placed if r["shard"] == shard) == list(range(counted[shard]))
    if not slack:
        assert max(counted.values()) - min(counted.values()) <= 1
    home = sum(owner[cell[r["doc_id"]]] == r["shard"] for r in placed)
    assert home >= sum(min(room[s], n) for s, n in Counter(owner[c] for c in cell.values()).items()) * 0.8


def test_hot_key_null_keys_and_ties(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), (F.col("id") % 5).alias("size"), F.lit("a").alias("slot"))
    placed = ring.place(rows, 16, ties=("size",), rows_per_task=50)
    sizes = [r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).where("n = d and m = n - 1").collect()]
    assert len(sizes) == 16 and set(sizes) == {125} and placed.where("doc_id is null").count() == 667
    once, again = (ring.place(rows.repartition(n, "size"), 16, ties=("size",)).orderBy("shard", "slot").collect() for n in (2, 5))
    assert once == again


def test_messy_and_empty(messy, none):
    assert ring.place(none, 16).count() == 0
    placed = ring.place(messy, 16)
    assert placed.columns == [*messy.columns, "shard", "slot"] and placed.count() == messy.count()
    assert ring.place(messy.limit(3), 16).groupBy("shard").count().agg(F.max("count")).first()[0] == 1


def test_one_more_shard_moves_little(spark):
    df = spark.range(40_000).withColumnRenamed("id", "doc_id")
    rows, moved = ring.moved(ring.place(df, 16), ring.place(df, 17)).first()
    assert rows == 40_000 and moved < 0.2 * rows  # 1/17 is the least; dealing out anew moves 16/17
    rows, moved = ring.moved(ring.place(df, 16, slack=0.1), ring.place(df, 17, slack=0.1)).first()
    assert moved < 0.1 * rows
