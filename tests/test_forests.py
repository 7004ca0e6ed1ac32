"""Forests grown level by level, against trees grown node by node."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from hydrofold.operators import clusters, forests


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    n = 600
    pdf = pd.DataFrame(rng.normal(size=(n, 3)).round(2), columns=["a", "b", "c"])
    pdf["som_x"], pdf["som_y"] = (pdf["a"] > 0.3).astype(int), (pdf["b"] + 0.2 * pdf["c"] > 0).astype(int)
    pdf["cluster"], pdf["gain"] = "x", 1.0
    return spark.createDataFrame(pdf).repartition(5).persist()


def gini(n, inside):
    return 2 * (inside / n) * (1 - inside / n)


def plain_tree(x, own, times, cluster, tree, depth, seed):
    found = {}

    def node(number, rows):
        n, inside = times[rows].sum(), times[rows][own[rows]].sum()
        if number >= 1 << depth or not n:
            return
        gains = np.zeros((x.shape[1], forests.BINS))
        for f in range(x.shape[1]):
            for b in range(forests.BINS):
                left = rows[x[rows, f] <= b]
                nl, il = times[left].sum(), times[left][own[left]].sum()
                if 0 < nl < n:
                    gains[f, b] = gini(n, inside) - nl / n * gini(nl, il) - (n - nl) / n * gini(n - nl, inside - il)
        order = np.random.default_rng([seed, cluster, tree, number]).permutation(x.shape[1])
        tried = max(1, round(x.shape[1] ** 0.5))
        first = max(order[:tried], key=lambda f: gains[f].max())
        for f in [first, *order[tried:]]:
            if gains[f].max() > 1e-12:
                b = int(gains[f].argmax())
                found[number] = (int(f), b, gains[f, b] * n)
                node(2 * number, rows[x[rows, f] <= b])
                node(2 * number + 1, rows[x[rows, f] > b])
                return

    node(1, np.arange(len(x)))
    return found


@pytest.mark.parametrize("room", [forests.COUNT_BYTES, 1])
def test_trees_equal_plain_growth(table, monkeypatch, room):
    monkeypatch.setattr(forests, "COUNT_BYTES", room)
    data = forests.binned(table, ["a", "b", "c"], ["som_x", "som_y"])
    rows = data.rows.collect()
    x, cluster, place = np.array([r["bins"] for r in rows]), np.array([r["cluster"] for r in rows]), np.array([r["place"] for r in rows])
    assert len(rows) == 600 and x.max() == forests.BINS - 1 and abs(np.bincount(x[:, 0]) - 600 / forests.BINS).max() < 12
    grown, gained = forests.grow(data, 3, 3, 7)
    for c in range(4):
        for t in range(3):
            want = plain_tree(x, cluster == c, forests._draws(place, t, 7), c, t, 3, 7)
            got = {n: (int(grown.feature[c, t, n]), int(grown.bin[c, t, n])) for n in range(1, 8) if grown.feature[c, t, n] >= 0}
            assert got == {n: v[:2] for n, v in want.items()}
            assert np.allclose(gained[c, t], [sum(v[2] for v in want.values() if v[0] == f) for f in range(3)])


def test_draws_are_poisson():
    place = np.random.default_rng(1).integers(-2 ** 63, 2 ** 63 - 1, 200_000)
    one, other = forests._draws(place, 0, 42), forests._draws(place, 1, 42)
    assert abs(one.mean() - 1) < 0.01 and abs(one.var() - 1) < 0.02 and abs(np.corrcoef(one, other)[0, 1]) < 0.01
    assert (forests._draws(place[::-1], 0, 42)[::-1] == one).all()


def test_importances_do_not_depend_on_the_layout(spark, table):
    one, other = (sorted(map(tuple, clusters.rf_importance_local(t, ["a", "b", "c"], trees=10).collect())) for t in (table, table.repartition(2, "a")))
    assert one == other and len(one) == 12
    top = clusters.top_importances(clusters.rf_importance_local(table, ["a", "b", "c"], trees=20), 2).collect()
    assert all({r["feature"] for r in top if (r["som_x"], r["som_y"]) == cell} == {"a", "b"} for cell in ((0, 0), (1, 1)))


def test_small_and_odd_tables(spark, table):
    assert clusters.rf_importance_local(table.limit(9), ["a", "b"]).count() == 0
    assert clusters.rf_importance_local(table.where("som_x = 0 and som_y = 0"), ["a", "b"]).count() == 0
    assert forests.root_gains(table.limit(0), ["a"], ["som_x"]).count() == 0
    constant = table.selectExpr("1.0 AS a", "b", "som_x", "som_y")
    found = {(r["som_x"], r["som_y"], r["feature"]): r["importance"] for r in clusters.rf_importance_local(constant, ["a", "b"], trees=5).collect()}
    assert all(v == (f == "b") for (_, _, f), v in found.items())
    assert set(forests.root_gains(constant, ["a", "b"], ["som_x", "som_y"]).toPandas()["feature"]) == {"b"}


def test_masks_name_the_nodes_that_a_walk_finds():
    rng = np.random.default_rng(2)
    clusters, features, bins = 3, 4, 8
    grown = forests.Trees(rng.integers(-1, features, (clusters, 2, 32)).astype(np.int8), rng.integers(0, bins, (clusters, 2, 32)).astype(np.int16))
    grown.feature[:, :, 0], grown.feature[:, :, 1] = -1, np.maximum(grown.feature[:, :, 1], 0)
    x = rng.integers(0, bins, (500, features))
    for level in range(1, 5):
        masks = grown.masks([1, 0], level, features, bins)
        for i, tree in enumerate((1, 0)):
            left = np.bitwise_and.reduce([masks[i, f][x[:, f]] for f in range(features)])
            node = grown.nodes(tree, x, level).T
            assert (left == np.where(node > 0, 1 << np.maximum(node - (1 << level), 0), 0)).all() and (node > 0).any()


def test_levels_beyond_masks_are_walked(table, monkeypatch):
    data = forests.binned(table, ["a", "b", "c"], ["som_x", "som_y"])
    masked = forests.grow(data, 2, 4, 7)
    monkeypatch.setattr(forests, "MASKED_NODES", 2)
    walked = forests.grow(data, 2, 4, 7)
    assert (masked[0].feature == walked[0].feature).all() and (masked[0].bin == walked[0].bin).all() and np.allclose(masked[1], walked[1])


def test_rows_of_the_global_forest_are_dealt_to_tasks_of_a_fixed_size(table, monkeypatch):
    dealt = []
    fit = clusters.RandomForestClassifier.fit
    monkeypatch.setattr(clusters.RandomForestClassifier, "fit", lambda self, rows: dealt.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    plain = {r["feature"]: r["importance"] for r in clusters.rf_importance_global(table, ["a", "b", "c"], trees=20).collect()}
    monkeypatch.setattr(clusters, "FOREST_TASK_ROWS", 30)
    small = {r["feature"]: r["importance"] for r in clusters.rf_importance_global(table, ["a", "b", "c"], trees=20).collect()}
    assert dealt == [5, 20] and all(abs(plain[f] - small[f]) < 0.1 for f in plain)


def test_folded_rows_grow_the_same_trees(table, monkeypatch):
    data = forests.binned(table.unionAll(table).repartition(3, "a"), ["a", "b"], ["som_x", "som_y"])
    plain, plain_gained = forests.grow(data, 3, 3, 7)
    for rows, room in ((forests.ROWS_AT_ONCE, forests.COUNT_BYTES), (40, 1)):  # a task that may hold few combinations passes them on early
        with monkeypatch.context() as m:
            m.setattr(forests, "ROWS_AT_ONCE", rows)
            m.setattr(forests, "COUNT_BYTES", room)
            fold = forests.folded(data, 3, 7)
        assert fold.folded
        grown, gained = forests.grow(fold, 3, 3, 7)
        assert (grown.feature == plain.feature).all() and (grown.bin == plain.bin).all() and (gained == plain_gained).all()
    large = replace(fold, size=1 << 40)
    assert fold.kind is np.int32 and large.kind is np.int64 and (forests.grow(large, 3, 3, 7)[1] == plain_gained).all()
    monkeypatch.setattr(forests, "FOLDED_PLACES", 100)
    assert forests.folded(data, 3, 7) is data


def test_folded_rows_are_bounded_by_combinations(spark, table):
    many = table.crossJoin(spark.range(50)).repartition(6)
    fold = forests.folded(forests.binned(many, ["a"], ["som_x", "som_y"]), 3, 7)
    rows = fold.rows.toPandas()
    assert len(rows) <= 4 * forests.BINS and not rows.assign(bins=rows["bins"].map(tuple)).duplicated(["bins", "cluster"]).any()
    one = forests.folded(forests.binned(table, ["a"], ["som_x", "som_y"]), 3, 7).rows.toPandas()
    total = lambda t: sum(np.frombuffer(x, np.int64) for x in t["times"])
    assert (total(rows) == 50 * total(one)).all()
