"""Exact nearest neighbours under the missing-aware Euclidean distance.

Distance uses the coordinates both rows hold, scaled up by the share of them: sqrt(D / common * sum of squares).
Of equal donor rows only the k with the smallest keys can be neighbours, so no point holds more. Donors are cut into
leaves by presence pattern and quantile cells, whose boxes form a tree. Groups of requests meet a copy of the tree each
and walk down it: first every request to its nearest leaf, which gives it a radius, then to every leaf whose box the
radius reaches. What is visited is the whole bin of such a leaf: the patterns of a quantile cell that are small lie in
one bin, so a request meets a region once and not once for each pattern. Equal requests are searched once, and bins that
many requests visit are copied. Nothing is gathered but the tree's cut points.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..schema import q
from ..session import checkpointed, released

LEAF_ROWS = 64  # of the blocks inside a task
BATCH_REQUESTS = 64
FIRST_BLOCKS = 4
PRODUCT_ROWS = 2048
#: Blocks are cut anew for requests that are at least this part of the rows. Cuts of so many times the rows are kept.
CUT_SHARE = 256
CUTS_KEPT = 4
CELL_ROWS = 131_072
TASK_REQUESTS = 5_000
WALK_REQUESTS = 20_000
WALK_CHUNK = 512
# Distances closer than this count as equal and the smaller key wins. Otherwise the last bits of a scaling
# fitted in another summation order would choose between mirror-image neighbours.
DISTANCE_DIGITS = 9
_SLACK = 10.0 ** -DISTANCE_DIGITS


# ---- search inside a task ----

@dataclass
class _Cut:
    """Rows in blocks of equal room (padded with NaN, where ``rows`` is -1) and the boxes of the blocks."""

    values: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(values: np.ndarray, rows: np.ndarray, features: list[int], leaf: int) -> "_Cut":
        """Halve all blocks at once, each along its widest coordinate, until a block holds at most ``leaf`` rows."""
        depth = max(0, int(np.ceil(np.log2(len(rows) / leaf))))
        at = np.full((1, -(-len(rows) // 2 ** depth) * 2 ** depth), len(rows))
        at[0, :len(rows)] = np.arange(len(rows))
        padded = np.vstack([values[rows], np.full((1, values.shape[1]), np.nan)])
        by = padded[:, features]
        for _ in range(depth):
            parts = by[at]
            width = np.nan_to_num(np.fmax.reduce(parts, axis=1) - np.fmin.reduce(parts, axis=1), nan=-1.0)
            along = np.take_along_axis(parts, width.argmax(axis=1)[:, None, None], axis=2)[:, :, 0]
            at = np.take_along_axis(at, np.argpartition(along, at.shape[1] // 2 - 1, axis=1), axis=1).reshape(2 * len(at), -1)
        at = at[(at < len(rows)).any(axis=1)]
        cells = padded[at]
        return _Cut(cells, np.append(rows, -1)[at], np.fmin.reduce(cells, axis=1), np.fmax.reduce(cells, axis=1))


class Blocks:
    """Donor rows with their keys, and blocks of each presence pattern cut along the coordinates that requests see."""

    def __init__(self, values: np.ndarray, keys: np.ndarray, leaf: int):
        self.values, self.keys, self.leaf = values, keys, leaf
        bits = presence_bits(values)
        self.rows = {int(b): np.flatnonzero(bits == b) for b in np.unique(bits) if b}
        self.cuts: dict[tuple[int, int], _Cut] = {}

    @staticmethod
    def build(values: np.ndarray, keys: np.ndarray, leaf: int = LEAF_ROWS) -> "Blocks":
        return Blocks(values, keys, leaf)

    def near(self, seen: int, target: int, requests: int) -> "_Near | None":
        """All rows that share a coordinate with such requests and hold their target; a cut is made for many requests only."""
        d, cuts, scales = self.values.shape[1], [], []
        for pattern, rows in self.rows.items():
            if pattern & seen and (target < 0 or pattern >> target & 1):
                by = pattern & seen if requests * CUT_SHARE >= len(rows) else pattern
                if (pattern, by) not in self.cuts:
                    self.cuts[pattern, by] = _Cut.of(self.values, rows, _bits(by, d), self.leaf)
                cuts.append(self.cuts[pattern, by])
                scales.append(np.full(len(cuts[-1].rows), d / (pattern & seen).bit_count()))
        while sum(len(self.rows[pattern]) for pattern, _ in self.cuts) > CUTS_KEPT * len(self.values):
            del self.cuts[next(iter(self.cuts))]
        return _Near(cuts, np.concatenate(scales), _bits(seen, d), self.keys) if cuts else None


def presence_bits(x: np.ndarray) -> np.ndarray:
    return (~np.isnan(x)).astype(np.int64) @ (np.int64(1) << np.arange(x.shape[1], dtype=np.int64))


def _bits(mask: int, d: int) -> list[int]:
    return [j for j in range(d) if mask >> j & 1]


class _Best:
    """The k best donors per request: distance, key, and place in the padded blocks (-1 for none)."""

    def __init__(self, n: int, k: int):
        self.distance = np.full((n, k), np.inf)
        self.key = np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64)
        self.place = np.full((n, k), -1, dtype=np.int64)

    def merge(self, row: np.ndarray, distance: np.ndarray, key: np.ndarray, place: np.ndarray) -> None:
        """Take in candidates (flat, any number per request); equal distances go to the smaller key."""
        k = self.distance.shape[1]
        touched = np.unique(row)
        row = np.concatenate([row, np.repeat(touched, k)])
        distance = np.concatenate([distance, self.distance[touched].ravel()])
        key = np.concatenate([key, self.key[touched].ravel()])
        place = np.concatenate([place, self.place[touched].ravel()])
        order = np.lexsort((key, distance, row))
        sorted_row = row[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_row, sorted_row)
        first = rank < k
        at, taken = (sorted_row[first], rank[first]), order[first]
        self.distance[at], self.key[at], self.place[at] = distance[taken], key[taken], place[taken]


class _Near:
    """Blocks that a group of requests with the same coordinates searches.

    Squared distances of a batch of requests to the rows of all blocks in reach come from one matrix product. Its rounding
    only ever adds rows to those whose distances are then computed plainly.
    """

    def __init__(self, cuts: list[_Cut], scale: np.ndarray, features: list[int], keys: np.ndarray):
        room = max(c.rows.shape[1] for c in cuts)
        fit = lambda a, fill: np.concatenate([a, np.full((len(a), room - a.shape[1], *a.shape[2:]), fill)], axis=1)
        self.values = np.concatenate([fit(c.values, np.nan)[:, :, features] for c in cuts])
        self.rows = np.concatenate([fit(c.rows, -1) for c in cuts])
        low, high = (np.concatenate([getattr(c, side)[:, features] for c in cuts]).T for side in ("low", "high"))
        missing = np.isnan(low)
        self.low, self.high = np.where(missing, -np.inf, low), np.where(missing, np.inf, high)  # no gap where nothing is held
        self.scale, self.keys = scale, keys
        self.sizes = (self.rows >= 0).sum(axis=1)
        self.origin = np.nan_to_num(np.nanmean(np.where(missing, np.nan, (low + high) / 2), axis=1)) if len(features) else np.zeros(0)
        c = self.values - self.origin
        known = ~np.isnan(c)
        c[~known] = 0.0
        squares = np.einsum("brj,brj->br", c, c)
        self.norm = squares.max(axis=1)
        squares[self.rows < 0] = np.inf
        # Scaled squares are sums of z*z*known - 2*z*c + c*c over the coordinates z of a request and c of a row.
        self.factors = np.concatenate([known.transpose(2, 0, 1), -2.0 * c.transpose(2, 0, 1), squares[None]]) * scale[:, None]

    def squares(self, z: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Scaled squared distances of requests to the rows of some blocks, infinite where a block is padded."""
        return z @ self.factors[:, of].reshape(len(self.factors), -1)

    def search(self, x: np.ndarray, at: np.ndarray, best: _Best, limit: np.ndarray) -> None:
        """The nearest rows of a batch of requests, which are the rows ``at`` of ``best``."""
        k, low, high = best.distance.shape[1], x.min(axis=0)[:, None], x.max(axis=0)[:, None]
        gap = np.maximum(np.maximum(self.low - high, low - self.high), 0.0)
        bound = np.sqrt(np.einsum("jb,jb->b", gap, gap) * self.scale) * (1.0 - 1e-9) - _SLACK
        center = x - self.origin
        z = np.hstack([center * center, center, np.ones((len(x), 1))])
        error = 1e-13 * (1.0 + x.shape[1]) * self.scale.max()
        reach = np.einsum("ij,ij->i", center, center).max()
        gap = np.maximum(np.maximum(self.low - (low + high) / 2, (low + high) / 2 - self.high), 0.0)
        first = np.arange(len(bound))
        if len(bound) > FIRST_BLOCKS:
            first = np.argpartition(np.einsum("jb,jb->b", gap, gap) * self.scale, FIRST_BLOCKS - 1)[:FIRST_BLOCKS]
        radius = limit
        if self.sizes[first].sum() >= k:
            kth = np.partition(self.squares(z, first), k - 1, axis=1)[:, k - 1] + error * (reach + self.norm[first].max())
            radius = np.minimum(limit, np.sqrt(np.maximum(kth, 0.0)) + _SLACK)
        inside = np.flatnonzero(bound <= radius.max())
        room = self.rows.shape[1]
        step = max(PRODUCT_ROWS // room, 1)
        if len(inside) > step:
            inside = inside[np.argsort(bound[inside], kind="stable")]
        for start in range(0, len(inside), step):
            of = inside[start:start + step]
            if start:
                radius = np.minimum(radius, best.distance[at, k - 1])
                of = of[bound[of] <= radius.max()]
                if not len(of):
                    break
            within = (radius + _SLACK) ** 2 * (1.0 + 1e-9) + error * (reach + self.norm[of].max())
            i, c = np.divmod(np.flatnonzero(self.squares(z, of) <= within[:, None]), len(of) * room)
            block, place = np.divmod(c, room)
            row, gaps = self.rows[of[block], place], self.values[of[block], place]
            gaps -= x[i]
            gaps *= gaps
            gaps[np.isnan(gaps)] = 0.0
            squares = np.zeros(len(gaps))
            for j in range(gaps.shape[1]):  # in the order of the coordinates
                squares += gaps[:, j]
            distance = np.round(np.sqrt(self.scale[of[block]] * squares), DISTANCE_DIGITS)
            kept = (distance <= limit[i]) & (row >= 0)  # a request of infinite radius meets the padding too
            best.merge(at[i[kept]], distance[kept], self.keys[row[kept]], row[kept])


def search(x: np.ndarray, target: np.ndarray, blocks: Blocks, k: int, limit: np.ndarray | None = None) -> _Best:
    """Exact k nearest donors per request; a target >= 0 admits only donors that hold that feature.

    Donors further away than a request's ``limit`` are none of its neighbours and are left out.
    """
    best = _Best(len(x), k)
    limit = np.full(len(x), np.inf) if limit is None else limit
    groups, member = np.unique(np.column_stack([presence_bits(x), target]), axis=0, return_inverse=True)
    ordered = np.argsort(member.ravel(), kind="stable")
    for (seen, wanted), rows in zip(groups.tolist(), np.split(ordered, np.cumsum(np.bincount(member.ravel()))[:-1])):
        near, features = blocks.near(seen, wanted, len(rows)), _bits(seen, x.shape[1])
        if near:
            for at in _Cut.of(x, rows, features, BATCH_REQUESTS).rows:
                at = at[at >= 0]
                near.search(x[at][:, features], at, best, limit[at])
    return best


# ---- Arrow edges ----

def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """List column of ``d`` doubles as a matrix, null as NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def _longs(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """List column of ``width`` longs as a matrix."""
    return column.combine_chunks().flatten().to_numpy().astype(np.int64).reshape(-1, width)


def _neighbour_columns(best: _Best, values: np.ndarray) -> dict[str, pa.Array]:
    found = best.place >= 0
    offsets = np.concatenate([[0], np.cumsum(found.sum(axis=1))]).astype(np.int32)
    d = values.shape[-1]
    flat = values.reshape(-1, d)[best.place[found]].ravel()
    return {
        "distances": pa.ListArray.from_arrays(offsets, pa.array(best.distance[found])),
        "donors": pa.ListArray.from_arrays(offsets, pa.array(best.key[found])),
        "donor_values": pa.ListArray.from_arrays((offsets * d).astype(np.int32), pa.array(flat, mask=np.isnan(flat))),
    }


NEIGHBOUR_FIELDS = [T.StructField("distances", T.ArrayType(T.DoubleType())), T.StructField("donors", T.ArrayType(T.LongType())),
                    T.StructField("donor_values", T.ArrayType(T.DoubleType()))]


# ---- the tree of cells ----

def _bit_list(array: str, d: int) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.get(array, F.lit(j)).isNotNull(), F.lit(1 << j)).otherwise(0) for j in range(d)]).cast("long")


def _cells(donors: DataFrame, d: int, cell_rows: int) -> DataFrame:
    """Donors with the ``path`` of their leaf.

    A path is the presence pattern, the quantile cell per cut feature, and a hash part of cells that are still too full;
    there are about as many cells as ``cell_rows`` asks for.
    """
    y = F.col("y")
    wanted = max(donors.count() / cell_rows, 1.0)
    cut_features = range(min(d, int(np.log2(wanted)) + 1)) if wanted > 1 else range(0)
    path = [_bit_list("y", d)]
    if cut_features:
        cuts = max(int(np.ceil(wanted ** (1.0 / len(cut_features)))), 2)
        splits = donors.agg(*[F.percentile_approx(y[j], [i / cuts for i in range(1, cuts)], F.lit(1000)) for j in cut_features]).first()
        path += [F.coalesce(F.size(F.filter(F.lit(list(dict.fromkeys(splits[j]))), lambda s, j=j: s < y[j])).cast("long"), F.lit(0).cast("long"))
                 if splits[j] else F.lit(0).cast("long") for j in cut_features]
    placed = donors.withColumn("cell", F.array(*path))
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(cell_rows)).alias("_parts"))
    split = placed.join(parts, "cell")  # adaptive execution picks the join
    part = F.pmod(F.xxhash64("donor_id"), F.col("_parts"))
    return split.select("donor_id", "y", F.concat("cell", F.array(part)).alias("path"))


def _with_bins(boxes: DataFrame, cell_rows: int) -> DataFrame:
    """Leaves with their ``bin``: all patterns of a quantile cell together, or the leaf itself where that were too many rows."""
    region = F.slice("path", 2, F.size("path") - 1)
    together = F.sum("n").over(Window.partitionBy(region)) <= 2 * cell_rows  # a leaf for each pattern
    return boxes.withColumn("bin", F.when(together, F.concat(F.array(F.lit(-1).cast("long")), region)).otherwise(F.col("path")))


@dataclass
class _Nodes:
    """The nodes of one depth in the order of their paths: boxes, rows, presence bits, and where their children begin."""

    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    present: np.ndarray
    children: np.ndarray


@dataclass
class _Tree:
    """All depths of a tree of leaves, and the bin of each leaf as a row of ``bins``."""

    levels: list[_Nodes]
    bins: np.ndarray
    bin_of: np.ndarray

    @staticmethod
    def build(path: np.ndarray, low: np.ndarray, high: np.ndarray, rows: np.ndarray, bins: np.ndarray) -> "_Tree":
        order = np.lexsort(path.T[::-1])
        path, low, high, rows = path[order], low[order], high[order], rows[order]
        differs = path[1:] != path[:-1]
        starts = [np.concatenate([[0], np.flatnonzero(differs[:, :depth].any(axis=1)) + 1]) for depth in range(1, path.shape[1] + 1)]
        levels = []
        for at, below in zip(starts, [*starts[1:], np.arange(len(path))]):
            levels.append(_Nodes(np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.add.reduceat(rows, at), path[at, 0],
                                 np.append(np.searchsorted(below, at), len(below))))
        distinct, bin_of = np.unique(bins[order], axis=0, return_inverse=True)
        return _Tree(levels, distinct, bin_of.ravel())

    def usable(self, seen: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(request, node) pairs of the first depth: presence patterns that share a feature with the request and hold its target."""
        present = self.levels[0].present[None]
        return np.nonzero(((present & seen[:, None]) != 0) & ((target[:, None] < 0) | (present >> np.maximum(target, 0)[:, None] & 1 == 1)))

    def below(self, depth: int, row: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of (request, node) pairs, in the same order."""
        first = self.levels[depth].children
        n = first[node + 1] - first[node]
        return np.repeat(row, n), np.repeat(first[node] - np.cumsum(n) + n, n) + np.arange(n.sum())


def _pair_bounds(x: np.ndarray, seen: np.ndarray, row: np.ndarray, nodes: _Nodes, node: np.ndarray, farthest: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Least and largest possible distance of (request, node) pairs, both with room for rounding."""
    a, low, high = x[row], nodes.low[node], nodes.high[node]
    common = seen[row] & nodes.present[node]
    scale = x.shape[1] / np.bitwise_count(common)
    below, above = low - a, a - high
    gap = np.maximum(np.maximum(below, above), 0.0)
    gap[np.isnan(gap)] = 0.0
    near = np.sqrt(scale * np.einsum("ij,ij->i", gap, gap)) * (1.0 - 1e-9) - _SLACK
    if not farthest:
        return near, None
    reach = np.maximum(-below, -above)
    reach[np.isnan(reach)] = 0.0
    return near, np.sqrt(scale * np.einsum("ij,ij->i", reach, reach)) * (1.0 + 1e-9) + _SLACK


def _nearest_leaves(tree: _Tree, x: np.ndarray, target: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(request, leaf, radius) of each request's nearest leaf, and a radius that holds k donors for certain."""
    seen = presence_bits(x)
    row, node = tree.usable(seen, target)
    radius = np.full(len(x), np.inf)
    for depth, nodes in enumerate(tree.levels):
        if depth:
            row, node = tree.below(depth - 1, row, node)
        if not len(row):
            break
        near, far = _pair_bounds(x, seen, row, nodes, node, True)
        enough = nodes.rows[node] >= k
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))  # pairs are in the order of the requests
        radius[row[first]] = np.minimum(radius[row[first]], np.minimum.reduceat(np.where(enough, far, np.inf), first))
        best = np.lexsort((node, -nodes.rows[node], near, ~enough, row))[first]
        row, node = row[best], node[best]
    return row, node, radius[row]


def _leaves_within(tree: _Tree, x: np.ndarray, target: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(request, leaf) pairs of all leaves that a request's radius reaches."""
    seen = presence_bits(x)
    row, node = tree.usable(seen, target)
    for depth, nodes in enumerate(tree.levels):
        if depth:
            row, node = tree.below(depth - 1, row, node)
        inside = _pair_bounds(x, seen, row, nodes, node, False)[0] <= radius[row]
        row, node = row[inside], node[inside]
    return row, node


def _walked(requests: DataFrame, boxes: DataFrame, d: int, k: int, groups: int) -> DataFrame:
    """Requests with ``bin`` and ``radius``: the first bin of each, or for requests with ``radius`` and ``known`` bin all others
    within the radius.

    Requests are dealt to groups, and each group gets a copy of the leaves' boxes.
    """
    first = "radius" not in requests.columns
    dealt = requests.withColumn("group", F.pmod(F.xxhash64("rid"), F.lit(groups)).cast("int"))
    copies = boxes.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, bins, radii = [], [], []
        if right.num_rows and left.num_rows:
            depth = len(right.column("path")[0])
            tree = _Tree.build(_longs(right.column("path"), depth), _matrix(right.column("low"), d), _matrix(right.column("high"), d),
                               right.column("n").to_numpy(), right.column("bin").to_numpy()[:, None])
            x, target = _matrix(left.column("x"), d), left.column("target").to_numpy().astype(np.int64)
            for start in range(0, len(x), WALK_CHUNK):
                part = slice(start, start + WALK_CHUNK)
                if first:
                    row, leaf, radius = _nearest_leaves(tree, x[part], target[part], k)
                    found = tree.bin_of[leaf]
                else:
                    known, limit = left.column("known").to_numpy()[part], left.column("radius").to_numpy()[part]
                    row, leaf = _leaves_within(tree, x[part], target[part], limit)
                    pairs = np.unique(row * len(tree.bins) + tree.bin_of[leaf])
                    row, found = np.divmod(pairs, len(tree.bins))
                    other = tree.bins[found, 0] != known[row]
                    row, found = row[other], found[other]
                    radius = limit[row]
                rows.append(row + start)
                bins.append(tree.bins[found, 0])
                radii.append(radius)
        row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        return pa.table({**{c: left.column(c).take(pa.array(row)) for c in ("rid", "x", "target")},
                         "bin": np.concatenate(bins) if bins else np.zeros(0, np.int64),
                         "radius": np.concatenate(radii) if radii else np.zeros(0)})

    met = dealt.repartition(groups, "group").groupBy("group").cogroup(copies.repartition(groups, "group").groupBy("group"))
    return met.applyInArrow(run, "rid long, x array<double>, target int, bin long, radius double")


def _visit(visits: DataFrame, leaves: DataFrame, boxes: DataFrame, d: int, k: int) -> DataFrame:
    """Neighbours per (request, bin) within the request's radius. Busy bins are copied so that no task serves too many requests.

    A copy serves requests that see the same coordinates, as far as possible: its blocks are cut along those.
    """
    # A copy serves at least half as many requests as it has rows: what is copied stays in proportion to the visits.
    size = boxes.groupBy("bin").agg(F.sum("n").alias("rows"))
    served_by_one = F.greatest(F.lit(float(TASK_REQUESTS)), F.col("rows") / 2)
    visits = visits.withColumn("seen", _bit_list("x", d))
    ahead = Window.partitionBy("bin").orderBy("seen")
    load = visits.groupBy("bin", "seen").agg(F.count("*").alias("here")).join(size, "bin").select(
        "bin", "seen", "here", (F.sum("here").over(ahead) - F.col("here")).alias("before"),
        F.sum("here").over(Window.partitionBy("bin")).alias("visits"), "rows")
    load = checkpointed(load.select("bin", "seen", "here", "before", "visits", F.ceil(F.col("visits") / served_by_one).alias("copies")), "bin-loads")
    once = load.where("before = 0").select("bin", "copies")
    # As many partitions as there are searches: their work lies in the requests, not in the bytes that sizes are told by.
    tasks = max(int(once.agg(F.coalesce(F.sum("copies"), F.lit(1))).first()[0]), visits.sparkSession.sparkContext.defaultParallelism)
    place = F.col("before") + F.pmod(F.xxhash64("rid"), F.col("here"))
    going = visits.join(load, ["bin", "seen"]).select("rid", "x", "target", "radius", "bin", F.floor(place * F.col("copies") / F.col("visits")).alias("copy"))
    served = leaves.join(once, "bin").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
    schema = T.StructType([T.StructField("rid", T.LongType()), *NEIGHBOUR_FIELDS])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        here = Blocks.build(_matrix(right.column("y"), d), right.column("donor_id").to_numpy().astype(np.int64))
        best = search(_matrix(left.column("x"), d), left.column("target").to_numpy().astype(np.int64), here, k, left.column("radius").to_numpy())
        return pa.table({"rid": left.column("rid"), **_neighbour_columns(best, here.values)})

    dealt = lambda side: side.repartition(tasks, "bin", "copy").groupBy("bin", "copy")
    return dealt(going).cogroup(dealt(served)).applyInArrow(run, schema)


def _merged(found: DataFrame, d: int, k: int) -> DataFrame:
    """The k best over all visited leaves; a request meets few leaves with k donors each."""
    entry = F.transform(F.sequence(F.lit(0), F.size("distances") - 1), lambda i: F.struct(
        F.get("distances", i).alias("distance"), F.get("donors", i).alias("donor"),
        F.slice("donor_values", i * d + 1, F.lit(d)).alias("values")))
    best = (found.where(F.size("distances") > 0).groupBy("rid")
            .agg(F.slice(F.sort_array(F.flatten(F.collect_list(entry))), 1, k).alias("_best")))
    return best.select("rid", F.col("_best.distance").alias("distances"), F.col("_best.donor").alias("donors"),
                       F.flatten("_best.values").alias("donor_values"))


# ---- operators ----

def _marked(array: str) -> Column:
    """An array of doubles whose nulls compare."""
    return F.transform(array, lambda v: F.coalesce(v, F.lit(float("nan"))))


def distinct_donors(donors: DataFrame, k: int) -> DataFrame:
    """``donor_id`` and ``y`` of donors that hold a value, of equal ones the k with the smallest keys."""
    # WindowGroupLimit keeps k rows a point and task before the shuffle.
    smallest = F.row_number().over(Window.partitionBy(_marked("y")).orderBy("donor_id"))
    return donors.where(F.exists("y", lambda v: v.isNotNull())).withColumn("_i", smallest).where(F.col("_i") <= k).select("donor_id", "y")


def means_of_nearest(x: np.ndarray, blocks: Blocks, k: int) -> np.ndarray:
    """Mean of every feature over the k nearest rows, NaN without any; equal requests are searched once."""
    once, member = np.unique(x, axis=0, return_inverse=True)
    best = search(once, np.full(len(once), -1), blocks, k)
    total = np.zeros(once.shape)
    for place in best.place.T:  # nearest first, as they are added elsewhere
        total += np.where(place[:, None] >= 0, blocks.values[place], 0.0)
    found = (best.place >= 0).sum(axis=1)[:, None]
    return np.where(found > 0, total / np.maximum(found, 1), np.nan)[member.ravel()]


def knn_join(requests: DataFrame, donors: DataFrame, d: int, k: int = 5, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Add the k nearest donors to every request: ``distances``, ``donors`` and their values end to end.

    ``requests``: unique ``request_id``, ``x`` (array of d doubles, null where unknown), ``target`` (feature the
    donor must hold, -1 for any). ``donors``: unique long ``donor_id`` and ``y``. Ties go to the smaller key.
    """
    if d > 62:
        raise ValueError("presence bits of a row fit one long: at most 62 features")
    distinct = checkpointed(distinct_donors(donors, k), "donors")
    leaves = checkpointed(_cells(distinct, d, cell_rows), "donor-leaves")
    released(distinct)
    boxes = checkpointed(_with_bins(leaves.groupBy("path").agg(
        F.count("*").alias("n"), F.array(*[F.min(F.get("y", F.lit(j))) for j in range(d)]).alias("low"),
        F.array(*[F.max(F.get("y", F.lit(j))) for j in range(d)]).alias("high")), cell_rows), "donor-boxes")
    numbers = checkpointed(boxes.select("bin").distinct().withColumn("_number", F.monotonically_increasing_id()), "bin-numbers")
    boxes = boxes.join(numbers, "bin").drop("bin").withColumnRenamed("_number", "bin")
    binned = checkpointed(leaves.join(boxes.select("path", "bin"), "path").drop("path"), "donor-bins")
    released(leaves)

    # A feature that every donor holds excludes nobody, so requests that differ only by it are equal.
    always = boxes.agg(F.coalesce(F.expr("bit_and(path[0])"), F.lit(0))).first()[0]
    bit = F.getbit(F.lit(always).cast("long"), F.greatest(F.col("target"), F.lit(0)))
    target = F.when((F.col("target") >= 0) & (bit == 0), F.col("target")).otherwise(-1)
    keyed = requests.withColumns({"_x": _marked("x"), "_target": target})
    once = keyed.groupBy("_x", F.col("_target").alias("target")).agg(F.first("x").alias("x")).withColumn("rid", F.monotonically_increasing_id())
    asked = checkpointed(once, "requests")
    n = asked.count()
    groups = max(-(-n // WALK_REQUESTS), min(requests.sparkSession.sparkContext.defaultParallelism, -(-n // WALK_CHUNK)), 1)
    start = checkpointed(_walked(asked.select("rid", "x", "target"), boxes, d, k, groups), "first-bins")
    first = checkpointed(_visit(start, binned, boxes, d, k), "first-visits")
    found = first.select("rid", F.when(F.size("distances") >= k, F.element_at("distances", -1)).alias("_kth"))
    ready = start.join(found, "rid", "left").select(
        "rid", "x", "target", F.col("bin").alias("known"), F.least("radius", F.coalesce("_kth", "radius")).alias("radius"))
    others = checkpointed(_walked(ready, boxes, d, k, groups), "other-bins")
    released(start)
    second = checkpointed(_visit(others, binned, boxes, d, k), "other-visits")
    released(others, binned)
    best = asked.select("_x", F.col("target").alias("_target"), "rid").join(_merged(first.unionByName(second), d, k), "rid", "left").drop("rid")
    best = checkpointed(best, "neighbours")  # plain shuffles below, so that a request of very many copies is split and no side is broadcast by a guess
    released(asked, first, second)
    empty = F.array().cast("array<double>")
    return keyed.hint("merge").join(best, ["_x", "_target"]).select(
        *[q(c) for c in requests.columns], F.coalesce("distances", empty).alias("distances"),
        F.coalesce("donors", F.array().cast("array<bigint>")).alias("donors"), F.coalesce("donor_values", empty).alias("donor_values"))


def neighbour_rows(joined: DataFrame, keep: Iterable[str] = ("request_id", "target")) -> DataFrame:
    """One row per neighbour with its 1-based rank."""
    return joined.select(*keep, F.posexplode(F.arrays_zip("distances", "donors")).alias("rank", "_n")).select(
        *keep, (F.col("rank") + 1).alias("rank"), F.col("_n.donors").alias("donor"), F.col("_n.distances").alias("distance"))


def neighbour_mean(feature: Column, d: int) -> Column:
    """Mean of one feature over the neighbours of a row, null without neighbours."""
    places = F.sequence(F.lit(0), F.size("donors") - 1)
    values = F.when(F.size("donors") > 0, F.transform(places, lambda i: F.get("donor_values", i * d + feature)))
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size("donors")


def vector(columns: list[str]) -> Column:
    """Columns as one array of doubles."""
    return F.array(*[q(c).cast("double") for c in columns])


def impute_requests(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One request per missing cell of the rows that hold at least one value."""
    missing = F.filter(F.array(*[F.when(q(c).isNull(), F.lit(j)) for j, c in enumerate(columns)]), lambda j: j.isNotNull())
    cells = df.select(q(key), vector(columns).alias("x"), F.explode(missing).alias("target"))
    return cells.select(key, "x", "target", F.concat_ws("-", q(key).cast("string"), F.col("target").cast("string")).alias("request_id"))


def knn_impute(df: DataFrame, key: str, columns: list[str], k: int = 5, donors: DataFrame | None = None,
               cell_rows: int = CELL_ROWS) -> DataFrame:
    """Fill nulls with the plain mean of the k nearest donors that hold the feature.

    Fewer donors give the mean of those; none gives the donors' column mean. Returns the whole table.
    """
    d = len(columns)
    source = df if donors is None else donors
    means = source.agg(*[F.avg(q(c)) for c in columns]).first()
    joined = knn_join(impute_requests(df, key, columns), source.select(q(key).alias("donor_id"), vector(columns).alias("y")), d, k,
                      cell_rows)
    fallback = F.array(*[F.lit(m).cast("double") for m in means])
    filled = joined.select(key, "target", F.coalesce(neighbour_mean(F.col("target"), d), F.get(fallback, F.col("target"))).alias("_v"))
    per_row = filled.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("target", "_v"))).alias("_filled"))  # at most d cells
    return df.join(per_row, key, "left").withColumns(
        {c: F.coalesce(q(c), F.try_element_at("_filled", F.lit(j))) for j, c in enumerate(columns)}).drop("_filled").select(*[q(c) for c in df.columns])
