"""Random forests of every cluster against the rest, grown together, level by level.

Features are cut into bins once. A level is one pass over the rows for all forests and all their trees: a task sends its
rows down the trees grown so far and counts them by (cluster, tree, node, feature, bin), inside the cluster and outside.
A row finds its node in the trees of all clusters at once, by masks looked up for its bins.
The counts of a tree are added up in one group, which returns the best split of each node, so a forest takes as many
passes as it is deep, however many clusters there are. How often a tree draws a row follows from a hash of the row.
Where bins and clusters have few combinations, rows are folded to these first, with the number of draws by each tree: then
the rows are read once, and the levels count combinations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..schema import q
from .profile import unpivot
from .ranking import exact_quantiles

# fixed values: bins of a feature, and fewest rows worth a forest
BINS = 32
FOREST_ROWS = 10
#: Bytes of counts that a task holds; trees beyond that are counted in another pass.
COUNT_BYTES = 64 << 20
#: Most combinations of bins and cluster to which rows are folded.
FOLDED_PLACES = 1 << 20
ROWS_AT_ONCE = 4096
#: Most nodes of a level whose masks fit 16 bits; larger levels walk down node by node.
MASKED_NODES = 16
#: Chances of being drawn at most 0, 1, 2, ... times with a mean of one.
DRAWN = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))


@dataclass(frozen=True)
class Binned:
    """Rows as (bins, cluster, place) with the cells that the cluster numbers stand for and the edges of each feature.

    Folded rows are (bins, cluster, times) with 64-bit draws by each tree in place of the hash.
    """

    rows: DataFrame
    cells: list[tuple]
    edges: list[np.ndarray]
    size: int
    folded: bool = False

    @property
    def features(self) -> int:
        return len(self.edges)

    @property
    def kind(self) -> type:
        """Of counts: a folded row may stand for any number, and a tree draws each up to ``len(DRAWN)`` times."""
        return np.int64 if self.folded and self.size * len(DRAWN) > np.iinfo(np.int32).max else np.int32


@dataclass
class Trees:
    """Splits of all trees: (cluster, tree, node); nodes count from 1 at the root, a node's children are 2n and 2n + 1."""

    feature: np.ndarray
    bin: np.ndarray

    @staticmethod
    def stumps(clusters: int, trees: int, depth: int) -> "Trees":
        shape = (clusters, trees, 1 << depth)
        return Trees(np.full(shape, -1, np.int8), np.zeros(shape, np.int16))

    def nodes(self, tree: int, bins: np.ndarray, level: int) -> np.ndarray:
        """The node at ``level`` of each row (clusters, rows), 0 where a branch ended before."""
        each, feature, at_most = np.arange(len(self.feature))[:, None], self.feature[:, tree], self.bin[:, tree]
        node = np.ones((len(feature), len(bins)), np.int64)
        for _ in range(level):
            by = feature[each, node]
            right = bins[np.arange(len(bins))[None, :], by] > at_most[each, node]
            node = np.where(by >= 0, 2 * node + right, 0)
        return node

    def masks(self, trees: list[int], level: int, features: int, bins: int) -> np.ndarray:
        """(tree, feature, bin, cluster): a bit for each node at ``level`` that a row with this bin of the feature may be in.

        The bits that a row's features have in common name its node; none are left where its branch ended before.
        """
        feature, at_most = (a[:, trees].transpose(1, 0, 2) for a in (self.feature, self.bin))
        open_ = np.full((len(trees), features, bins, len(self.feature)), (1 << (1 << level)) - 1, np.uint16)
        each = np.arange(bins)[:, None]
        for above in range(level):
            half = 1 << (level - above - 1)  # nodes at the level below each child
            for node in range(1 << above, 2 << above):
                left = ((1 << half) - 1) << ((node - (1 << above)) * 2 * half)
                goes_left = each <= at_most[:, None, :, node]
                sides = np.where(goes_left, np.uint16(0xFFFF ^ (left << half)), np.uint16(0xFFFF ^ left))
                for f in range(features):
                    open_[:, f] &= np.where(feature[:, None, :, node] == f, sides, np.uint16(0xFFFF))
                open_[:, 0] &= np.where(feature[:, None, :, node] < 0, np.uint16(0xFFFF ^ (left | left << half)), np.uint16(0xFFFF))
        return open_


def binned(df: DataFrame, columns: list[str], by: list[str], bins: int = BINS) -> Binned | None:
    """Complete rows with their values as bins between quantiles; None with too few rows or a single cluster.

    Rows that agree in all columns have one place: a tree draws them equally often.
    """
    complete = df.dropna("any", subset=[*columns, *by]).select(*[q(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)], *by)
    counted = complete.groupBy(*by).agg(F.count("*").alias("n")).orderBy(*by).collect()  # a row for each cluster
    if len(counted) < 2 or sum(r["n"] for r in counted) < FOREST_ROWS:
        return None
    cells = [tuple(r[c] for c in by) for r in counted]
    names = [f"v{i}" for i in range(len(columns))]
    quantiles = exact_quantiles(unpivot(complete, names), ["feature"], "value", [i / bins for i in range(1, bins)]).collect()  # a row for each feature
    cuts = {r["feature"]: np.unique(r["quantiles"]) for r in quantiles}
    edges = [cuts[n] for n in names]
    place_of = lambda n, e: F.size(F.filter(F.array(*[F.lit(float(x)) for x in e]), lambda x: x < F.col(n)))
    numbers = df.sparkSession.createDataFrame([(*cell, i) for i, cell in enumerate(cells)], [*[f"_{c}" for c in by], "cluster"])
    known = complete.join(F.broadcast(numbers), [complete[c] == numbers[f"_{c}"] for c in by])  # a row for each cluster
    rows = known.select(F.array(*[place_of(n, e).cast("short") for n, e in zip(names, edges)]).alias("bins"), F.col("cluster").cast("int"),
                        F.xxhash64(*names, *by).alias("place"))
    return Binned(rows, cells, edges, sum(r["n"] for r in counted))


def _draws(place: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row: its hash, mixed with tree and seed, as a number in [0, 1)."""
    with np.errstate(over="ignore"):
        x = place.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(tree + 1 + (seed << 20))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    chance, times = (x >> np.uint64(11)).astype(np.float64) / (1 << 53), np.zeros(len(x), np.int64)
    for least in DRAWN:
        more = chance >= least
        if not more.any():
            break
        times += more
    return times


def _read(part: pa.RecordBatch, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins (feature, row) and clusters of a batch."""
    bins = np.ascontiguousarray(part.column("bins").flatten().to_numpy().reshape(-1, features).T).astype(np.int64)
    return bins, part.column("cluster").to_numpy().astype(np.int64)


def _times(part: pa.RecordBatch) -> np.ndarray:
    """Draws (row, tree) of folded rows."""
    return np.frombuffer(b"".join(part.column("times").to_pylist()), np.int64).reshape(part.num_rows, -1)


def folded(data: Binned, trees: int, seed: int) -> Binned:
    """Rows that agree in bins and cluster as one, with the sum of their draws by each tree, where the combinations are few enough.

    A task adds up its rows before they are dealt by combination and added up once more, so a frequent one costs a row a task.
    """
    features, shape = data.features, (len(data.cells), *(len(e) + 1 for e in data.edges))
    if np.prod(shape, dtype=float) > FOLDED_PLACES:
        return data
    most = max(ROWS_AT_ONCE, COUNT_BYTES // (8 * trees))  # combinations that a task holds before it passes them on

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, codes, total, held = np.full(np.prod(shape), -1), np.zeros(most, np.int64), np.zeros((most, trees), np.int64), 0

        def sent() -> Iterator[pa.RecordBatch]:
            for at in range(0, held, ROWS_AT_ONCE):
                some = slice(at, min(held, at + ROWS_AT_ONCE))
                cluster, *bins = np.unravel_index(codes[some], shape)
                flat = pa.array(np.stack(bins, axis=1).ravel().astype(np.int16))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, features), pa.int32()), flat)
                times = pa.array([row.tobytes() for row in total[some]], pa.binary())
                yield pa.RecordBatch.from_arrays([lists, pa.array(cluster.astype(np.int32)), times], names=["bins", "cluster", "times"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                bins, cluster = _read(part, features)
                code = np.ravel_multi_index((cluster, *bins), shape)
                order = code.argsort(kind="stable")
                found, begin = np.unique(code[order], return_index=True)
                if held + len(found) > most:
                    yield from sent()
                    slot[codes[:held]], total[:held], held = -1, 0, 0
                new = found[slot[found] < 0]
                slot[new] = np.arange(held, held + len(new))
                codes[held:held + len(new)] = new
                held += len(new)
                if "times" in part.schema.names:
                    total[slot[found]] += np.add.reduceat(_times(part)[order], begin, axis=0)
                else:
                    place = part.column("place").to_numpy()[order]
                    total[slot[found]] += np.stack([np.add.reduceat(_draws(place, tree, seed), begin) for tree in range(trees)], axis=1)
        yield from sent()

    schema, cores = "bins array<short>, cluster int, times binary", data.rows.sparkSession.sparkContext.defaultParallelism
    # Not more tasks than cores: a task of a level returns counts of all nodes, however few its rows are, and these rows are bounded.
    dealt = data.rows.mapInArrow(fold, schema).repartition(cores, "cluster", "bins")
    return replace(data, rows=dealt.mapInArrow(fold, schema), folded=True)


def level_counts(data: Binned, grown: Trees, level: int, trees: list[int], seed: int, sampled: bool = True, bins: int = BINS) -> DataFrame:
    """(cluster, tree, counts): a task's counts of one tree (node, feature, bin, inside), for each task."""
    clusters, features, nodes, kind, fold = len(data.cells), data.features, 1 << level, data.kind, data.folded
    masked = nodes <= MASKED_NODES
    number = np.full(1 << min(nodes, MASKED_NODES), nodes * bins)  # by a mask: where the counts of its node begin, ended branches last
    number[1 << np.arange(min(nodes, MASKED_NODES))] = np.arange(min(nodes, MASKED_NODES)) * bins
    slots = (nodes + 1) * bins
    first = np.arange(clusters) * slots

    def places(grown_masks: np.ndarray, tree: int, x: np.ndarray) -> np.ndarray:
        """Where the counts of each row's node begin (rows, clusters), within those of the cluster."""
        if not masked:
            node = grown.nodes(tree, x.T, level).T
            return np.where(node > 0, node - nodes, nodes) * bins
        left = grown_masks[0].take(x[0], axis=0)
        for f in range(1, features):
            left &= grown_masks[f].take(x[f], axis=0)
        return number.take(left)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # All rows by the node they are in for each cluster; those of the cluster itself are a row's own once more.
        both, inside = (np.zeros((len(trees), features, clusters * slots), kind) for _ in range(2))
        masks = grown.masks(trees, level, features, bins) if masked and level else [None] * len(trees)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                table, cluster = _read(part, features)
                draws = _times(part) if fold else None
                for i, tree in enumerate(trees):
                    if fold:
                        times = draws[:, tree]
                    else:
                        times = _draws(part.column("place").to_numpy(), tree, seed) if sampled else np.ones(len(cluster), np.int64)
                    drawn = np.flatnonzero(times)
                    x, own, times = table[:, drawn], cluster[drawn], times[drawn].astype(np.float64)
                    if level:
                        begin = places(masks[i], tree, x)
                        mine = begin[np.arange(len(own)), own] + first[own]
                        begin, each = begin + first, np.repeat(times, clusters)
                        for f in range(features):
                            both[i, f] += np.bincount((begin + x[f][:, None]).ravel(), each, clusters * slots).astype(kind)
                    else:  # all rows are in the root
                        mine = first[own]
                    for f in range(features):
                        inside[i, f] += np.bincount(mine + x[f], times, clusters * slots).astype(kind)
        shaped = lambda counts: counts.reshape(len(trees), features, clusters, nodes + 1, bins)[:, :, :, :nodes]
        own, whole = shaped(inside), shaped(both) if level else shaped(inside).sum(axis=2, keepdims=True, dtype=kind)
        shaped = np.stack([whole - own, own], axis=-1).transpose(2, 0, 3, 1, 4, 5)
        for c in range(clusters):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(trees), c, np.int32)), pa.array(trees, pa.int32()), pa.array([shaped[c, i].tobytes() for i in range(len(trees))], pa.binary())],
                names=["cluster", "tree", "counts"])

    return data.rows.mapInArrow(count, "cluster int, tree int, counts binary")


def _summed(table: pa.Table, nodes: int, features: int, bins: int, kind: type) -> np.ndarray:
    total = np.zeros((nodes, features, bins, 2))
    for piece in table.column("counts").to_pylist():
        total += np.frombuffer(piece, kind).reshape(total.shape)
    return total


def split_gains(counts: np.ndarray) -> np.ndarray:
    """Loss of Gini impurity by splitting after each bin, from (..., bin, inside) counts; 0 where a side is empty."""
    left = counts.cumsum(axis=-2)
    whole = left[..., -1:, :]
    right = whole - left
    size = lambda c: c.sum(axis=-1)
    impure = lambda c: 2 * c[..., 0] * c[..., 1] / np.maximum(size(c), 1) ** 2
    n = np.maximum(size(whole), 1)
    gain = impure(whole) - size(left) / n * impure(left) - size(right) / n * impure(right)
    return np.where((size(left) > 0) & (size(right) > 0), gain, 0.0)


def _best(table: pa.Table, level: int, features: int, bins: int, seed: int, kind: type) -> pa.Table:
    """The best split of each node of a tree among some features drawn for the node, or among the next that has one."""
    cluster, tree = table.column("cluster")[0].as_py(), table.column("tree")[0].as_py()
    counts = _summed(table, 1 << level, features, bins, kind)
    gains, weight, found = split_gains(counts), counts[:, 0].sum(axis=(1, 2)), []
    tried = max(1, round(features ** 0.5))
    for i in np.flatnonzero(weight):
        node, best = (1 << level) + int(i), gains[i].max(axis=1)
        order = np.random.default_rng([seed, cluster, tree, node]).permutation(features)
        first = order[:tried][best[order[:tried]].argmax()]
        usable = [first, *order[tried:]]
        feature = next((int(f) for f in usable if best[f] > 1e-12), None)
        if feature is not None:
            found.append((cluster, tree, node, feature, int(gains[i, feature].argmax()), float(best[feature]), float(weight[i])))
    columns = list(zip(*found)) if found else [[]] * 7
    kinds = [pa.int32()] * 5 + [pa.float64()] * 2
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["cluster", "tree", "node", "feature", "bin", "gain", "weight"])


def grow(data: Binned, trees: int, depth: int, seed: int) -> tuple[Trees, np.ndarray]:
    """All trees of all forests, and the importance of the features in each tree (cluster, tree, feature)."""
    clusters, features, kind = len(data.cells), data.features, data.kind
    grown, gained = Trees.stumps(clusters, trees, depth), np.zeros((clusters, trees, features))
    for level in range(depth):
        size = clusters * ((1 << level) + 1) * features * BINS * 2 * np.dtype(kind).itemsize
        together = max(1, COUNT_BYTES // size)
        for at in range(0, trees, together):
            counts = level_counts(data, grown, level, list(range(at, min(trees, at + together))), seed)
            schema = "cluster int, tree int, node int, feature int, bin int, gain double, weight double"
            best = counts.groupBy("cluster", "tree").applyInArrow(lambda t: _best(t, level, features, BINS, seed, kind), schema)  # noqa: B023
            for c, t, node, f, b, gain, weight in best.collect():  # the splits of one level
                grown.feature[c, t, node], grown.bin[c, t, node] = f, b
                gained[c, t, f] += gain * weight
    return grown, gained


def importances(gained: np.ndarray) -> np.ndarray:
    """(cluster, feature): shares of each tree's gain, averaged over the trees that have a split."""
    total = gained.sum(axis=2, keepdims=True)
    shares = np.divide(gained, total, out=np.zeros_like(gained), where=total > 0).sum(axis=1)
    whole = shares.sum(axis=1, keepdims=True)
    return np.divide(shares, whole, out=np.zeros_like(shares), where=whole > 0)


def root_gains(df: DataFrame, columns: list[str], by: list[str], bins: int = BINS) -> DataFrame:
    """(*by, feature, bin, gain): what splitting all rows after each bin of a feature tells about each cluster."""
    data = binned(df, columns, by, bins)
    kinds = ", ".join(f"{c} {df.select(q(c)).schema[0].dataType.simpleString()}" for c in by)
    schema = f"{kinds}, feature string, bin int, gain double"
    if data is None:
        return df.sparkSession.createDataFrame([], schema)
    features, kind, sides = data.features, data.kind, [len(e) for e in data.edges]

    def gains(table: pa.Table) -> pa.Table:
        cluster = table.column("cluster")[0].as_py()
        found = split_gains(_summed(table, 1, features, bins, kind))[0]
        rows = [(cluster, f, b, float(found[f, b])) for f in range(features) for b in range(sides[f]) if found[f, b] > 0]
        columns_ = list(zip(*rows)) if rows else [[]] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns_, [pa.int32(), pa.int32(), pa.int32(), pa.float64()])], names=["cluster", "place", "bin", "gain"])

    counts = level_counts(data, Trees.stumps(len(data.cells), 1, 1), 0, [0], 0, sampled=False, bins=bins)
    rows = counts.groupBy("cluster").applyInArrow(gains, "cluster int, place int, bin int, gain double").collect()  # clusters x features x bins
    return df.sparkSession.createDataFrame([(*data.cells[r["cluster"]], columns[r["place"]], r["bin"], r["gain"]) for r in rows], schema)
