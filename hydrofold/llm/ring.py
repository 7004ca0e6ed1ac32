"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, by DataFrame functions alone.

The ring has a fixed number of cells. A key's hash names its cell, and the first virtual node at or clockwise after the
cell owns it. Shards have room for a bounded number of rows: going clockwise from the first cell, a cell's own rows come
first, rows that find their shard full go on to the next cell's shard, and a second lap places what is left. Which row
goes where follows from the number of rows in each cell, so a table of at most a row per cell and per
``rows_per_task`` rows is all the walk needs, and it numbers the rows of each shard on the way.
"""

from __future__ import annotations

import hashlib
from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..schema import q
from ..session import checkpointed
from .texts import fresh

CELL_BITS = 16
VIRTUAL_NODES = 512
ROWS_PER_TASK = 250_000


def owners(shards: int, virtual_nodes: int = VIRTUAL_NODES, cell_bits: int = CELL_BITS, seed: int = 0) -> list[int]:
    """The shard of each cell. Virtual nodes of a shard lie where a digest of their name says, whatever other shards there are."""
    cells = 1 << cell_bits
    nodes: dict[int, tuple[str, int]] = {}
    for shard in range(shards):
        for node in range(virtual_nodes):
            digest = hashlib.md5(f"{seed}:{shard}:{node}".encode()).hexdigest()
            cell = int(digest[:8], 16) % cells
            nodes[cell] = min(nodes.get(cell, (digest, shard)), (digest, shard))
    at = nodes[min(nodes)][1]  # past the last node the ring begins again
    found = [0] * cells
    for cell in reversed(range(cells)):
        at = nodes[cell][1] if cell in nodes else at
        found[cell] = at
    return found


def rooms(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Most rows of each shard: without slack as equal as whole rows allow, else (1 + slack) times the mean."""
    if slack > 0:
        return [-int(-(1 + slack) * rows // shards)] * shards
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def walk(sizes: list[tuple[int, int, int]], owner: list[int], room: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """(cell, part, start, end, shard, slot): which rows of each part of a cell go where, and the first one's place there.

    ``sizes`` holds (cell, part, rows). Each step of a lap fills a shard, empties a piece or ends a cell, so there are
    at most as many rows as parts and two laps of cells.
    """
    own: dict[int, list[tuple[int, int]]] = {}
    for cell, part, rows in sorted(sizes):
        own.setdefault(cell, []).append((part, rows))
    used, placed, waiting = [0] * len(room), [], deque()

    def take(piece: tuple[int, int, int, int], shard: int) -> tuple[int, int, int, int] | None:
        cell, part, start, end = piece
        fits = min(end - start, room[shard] - used[shard])
        if fits:
            placed.append((cell, part, start, start + fits, shard, used[shard]))
            used[shard] += fits
        return (cell, part, start + fits, end) if start + fits < end else None

    for lap in range(2):
        for cell, shard in enumerate(owner):
            left = [take((cell, part, 0, rows), shard) for part, rows in own.get(cell, [])] if lap == 0 else []
            while waiting and used[shard] < room[shard]:
                rest = take(waiting.popleft(), shard)
                if rest:
                    waiting.appendleft(rest)
            waiting.extend(piece for piece in left if piece)
    return placed


def _small(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """Whole numbers of the driver as a written table, so that plans do not carry them along."""
    return checkpointed(spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names.split())), "ring-plan")


def place(df: DataFrame, shards: int, key: str = "doc_id", ties: tuple[str, ...] = (), shard: str = "shard", slot: str = "slot",
          slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES, cell_bits: int = CELL_BITS, rows_per_task: int = ROWS_PER_TASK,
          seed: int = 0) -> DataFrame:
    """``df`` plus ``shard`` and ``slot``, the row's place in its shard from 0 without gaps.

    Without ``slack`` the numbers of rows of two shards differ by one at most; with it a shard holds at most
    (1 + slack) times the mean and fewer rows move when shards are added. A null key is a key like any other. Rows of equal
    keys share a cell and are ordered by ``ties``, then by where they lie in ``df``: rows that agree in both are alike.
    A cell of more than ``rows_per_task`` rows, such as that of one key that many rows share, is numbered in as many
    parts as that takes, and its rows may be dealt to several shards. An empty table stays empty; columns of ``df``
    called ``shard`` or ``slot`` are replaced. ``df`` is written once and read from there.
    """
    spark, df = df.sparkSession, df.drop(shard, slot)
    names = df.columns
    hashed, cell, row, part, number, pieces = (fresh(df, n) for n in ("_hash", "_cell", "_row", "_part", "_number", "_pieces"))
    hash_of_key = F.xxhash64(F.lit(seed), F.coalesce(q(key).cast("string"), F.lit("")))
    kept = checkpointed(df.withColumns({hashed: hash_of_key, row: F.monotonically_increasing_id()}).withColumn(
        cell, F.shiftrightunsigned(hashed, 64 - cell_bits)), "ring")
    counts = kept.groupBy(cell).agg(F.count("*").alias("n")).collect()  # a row per cell at most
    total = sum(r["n"] for r in counts)
    parts = [(r[cell], -(-r["n"] // rows_per_task)) for r in counts]
    split = [(c, n) for c, n in parts if n > 1]  # fewer than rows / rows_per_task
    n_parts = F.lit(1)
    if split:
        kept = kept.join(_small(spark, split, "c n").withColumnsRenamed({"c": cell, "n": part}), cell, "left")
        n_parts = F.coalesce(F.col(part), F.lit(1))
    kept = kept.withColumn(part, F.pmod(F.xxhash64(row), n_parts))
    if split:
        sizes = [tuple(r) for r in kept.groupBy(cell, part).agg(F.count("*").alias("n")).collect()]
    else:
        sizes = [(r[cell], 0, r["n"]) for r in counts]
    placed = walk(sizes, owners(shards, virtual_nodes, cell_bits, seed), rooms(total, shards, slack))
    plan = _small(spark, placed, "c p start end shard slot").groupBy("c", "p").agg(
        F.collect_list(F.struct("start", "end", "shard", "slot")).alias(pieces)).withColumnsRenamed({"c": cell, "p": part})
    inside = Window.partitionBy(cell, part).orderBy(hashed, *map(q, ties), row)
    numbered = kept.withColumn(number, (F.row_number().over(inside) - 1).cast("long")).join(plan, [cell, part])
    mine = F.filter(pieces, lambda p: (p["start"] <= F.col(number)) & (F.col(number) < p["end"]))[0]
    return numbered.withColumn(pieces, mine).select(
        *map(q, names), F.col(f"{pieces}.shard").cast("int").alias(shard), (F.col(f"{pieces}.slot") + F.col(number) - F.col(f"{pieces}.start")).alias(slot))


def moved(before: DataFrame, after: DataFrame, key: str = "doc_id", shard: str = "shard") -> DataFrame:
    """(rows, moved): unique keys of two placements, and those whose shard differs."""
    both = before.select(q(key).alias("k"), q(shard).alias("a")).join(after.select(q(key).alias("k"), q(shard).alias("b")), "k")
    return both.agg(F.count("*").alias("rows"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("moved"))
