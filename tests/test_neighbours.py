import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hydrofold.operators import benchmark, evaluation, knn

COLUMNS = ["a", "b", "c"]


def fixture_rows(seed: int, n: int = 700) -> np.ndarray:
    """Clustered points, a third of them one and the same, a fifth of the cells missing."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)) * [1, 5, 0.2] + rng.integers(0, 3, (n, 1)), 2)
    x[rng.random(n) < 0.33] = [1.0, 2.0, 3.0]
    x[rng.random(x.shape) < 0.2] = np.nan
    return x


def brute_force(x: np.ndarray, k: int) -> np.ndarray:
    out = x.copy()
    means = np.nanmean(x, axis=0)
    for i, j in np.argwhere(np.isnan(x)):
        common = ~np.isnan(x[i]) & ~np.isnan(x)
        n = common.sum(axis=1)
        squares = np.where(common, np.nan_to_num((x - x[i]) ** 2), 0.0).sum(axis=1)
        distance = np.where((n > 0) & ~np.isnan(x[:, j]), np.round(np.sqrt(3 / np.maximum(n, 1) * squares), knn.DISTANCE_DIGITS), np.inf)
        nearest = [r for r in np.lexsort((np.arange(len(x)), distance))[:k] if np.isfinite(distance[r])]
        if (~np.isnan(x[i])).any():
            out[i, j] = x[nearest, j].mean() if nearest else means[j]
        else:
            out[i, j] = means[j]
    return out


@pytest.mark.parametrize("cell_rows", [10 ** 6, 64])
@pytest.mark.parametrize("k", [1, 5])
def test_imputation_equals_brute_force(spark, monkeypatch, cell_rows, k):
    monkeypatch.setattr(knn, "TASK_REQUESTS", 50)
    x = fixture_rows(4)
    pdf = pd.DataFrame(x, columns=COLUMNS).assign(id=np.arange(len(x)))
    df = spark.createDataFrame(pdf).select("id", *[F.nanvl(c, F.lit(None)).alias(c) for c in COLUMNS])
    got = knn.knn_impute(df, "id", COLUMNS, k, cell_rows=cell_rows).orderBy("id").toPandas()[COLUMNS].to_numpy(float)
    assert np.allclose(got, brute_force(x, k), rtol=0, atol=1e-9)


@pytest.mark.parametrize("cell_rows", [10 ** 6, 64])
def test_fewer_donors_than_neighbours(spark, cell_rows):
    rows = [(0, None, 1.0), (1, 4.0, 2.0), (2, 8.0, None), (3, None, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    out = {r["id"]: r for r in knn.knn_impute(df, "id", ["a", "b"], 5, cell_rows=cell_rows).collect()}
    assert out[0]["a"] == 4.0  # the other holder of a shares no coordinate
    assert out[2]["b"] == 2.0
    assert out[3]["a"] == 6.0 and out[3]["b"] == 1.5  # nothing in common with anyone: column means


@pytest.mark.parametrize("incomplete", [False, True])
def test_benchmark_paths_agree_and_beat_the_mean(spark, monkeypatch, incomplete):
    rng = np.random.default_rng(0)
    v = rng.normal(size=400)
    pdf = pd.DataFrame({"id": np.arange(400), "a": v, "b": 2 * v + 0.1 * rng.normal(size=400), "c": -v + 0.1 * rng.normal(size=400)})
    if incomplete:
        pdf.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(pdf).select("id", *[F.nanvl(c, F.lit(None)).alias(c) for c in COLUMNS])
    runs = {}
    for cells in (10 ** 6, 50):
        make = lambda train, cells=cells: benchmark.knn_imputer(train, "id", COLUMNS, 5, cells)
        rows = benchmark.mask_benchmark(df, "id", COLUMNS, make, include_incomplete=incomplete)
        runs[cells] = rows.orderBy("id", "level", "combination", "feature").toPandas()
    pd.testing.assert_frame_equal(runs[10 ** 6], runs[50])
    mean = evaluation.imputation_metrics(benchmark.mask_benchmark(df, "id", COLUMNS, lambda t: benchmark.mean_imputer(COLUMNS)), ["level"])
    knn_scores = evaluation.imputation_metrics(spark.createDataFrame(runs[50].drop(columns="combination")), ["level"])
    worse = mean.join(knn_scores.withColumnRenamed("rmse", "knn"), "level").where("knn >= rmse")
    assert worse.count() == 0
    hidden = runs[50].groupby("level")["combination"].apply(lambda c: {len(x) for x in c})
    assert hidden.to_dict() == {1: {1}, 2: {2}}


def test_visits_return_no_donor_beyond_the_limit():
    """What a request knows already bounds what later visits send on."""
    rng = np.random.default_rng(1)
    donors, x = rng.random((500, 3)), rng.random((40, 3))
    distance = np.round(np.sqrt(((x[:, None] - donors) ** 2).sum(axis=2)), knn.DISTANCE_DIGITS)
    limit = np.sort(distance, axis=1)[:, 2]
    best = knn.search(x, np.full(40, -1), knn.Blocks.build(donors, np.arange(500), 16), 5, limit)
    assert ((best.place >= 0).sum(axis=1) == 3).all()
    assert (best.key[:, :3] == np.argsort(distance, axis=1)[:, :3]).all()


def test_tree_walk_meets_every_leaf_in_reach():
    rng = np.random.default_rng(2)
    values = rng.random((3000, 3))
    values[rng.random(values.shape) < 0.3] = np.nan
    values = values[~np.isnan(values).all(axis=1)]
    path = np.column_stack([knn.presence_bits(values), *(np.nan_to_num(values[:, j] * 4).astype(np.int64) for j in range(2))])
    leaves, member = np.unique(path, axis=0, return_inverse=True)
    member = member.ravel()
    low, high = (np.array([f(values[member == i], axis=0) for i in range(len(leaves))]) for f in (np.min, np.max))
    tree = knn._Tree.build(leaves, low, high, np.bincount(member), leaves)
    x, target = values[:200], rng.integers(-1, 3, 200)
    row, leaf, radius = knn._nearest_leaves(tree, x, target, 5)
    assert (row == np.arange(200)).all() and (tree.bin_of[leaf] >= 0).all()
    found = set(zip(*(a.tolist() for a in knn._leaves_within(tree, x, target, np.minimum(radius, 0.2)))))
    for i in range(200):
        for j, leaf in enumerate(leaves):
            rows = values[member == j]
            common = ~np.isnan(rows[0]) & ~np.isnan(x[i])
            if common.any() and (target[i] < 0 or not np.isnan(rows[0, target[i]])):
                near = np.sqrt(3 / common.sum() * ((rows[:, common] - x[i, common]) ** 2).sum(axis=1)).min()
                if near <= min(radius[i], 0.2):
                    assert (i, j) in found
    kth = [np.sort(np.concatenate([np.sqrt(3 / c.sum() * ((values[p][:, c] - x[i, c]) ** 2).sum(axis=1)) for b in np.unique(path[:, 0])
                                   if (c := (p := path[:, 0] == b).any() & ~np.isnan(values[p][0]) & ~np.isnan(x[i])).any()
                                   and (target[i] < 0 or b >> target[i] & 1)]))[4] for i in range(200)]
    assert (radius >= kth).all()


def test_copies_of_a_bin_stay_in_proportion_to_its_visits(spark, monkeypatch):
    """400 requests of a bin with 2,000 donors, 10 a task: one copy serves them all, not 40."""
    monkeypatch.setattr(knn, "TASK_REQUESTS", 10)
    loads, keep = [], knn.checkpointed
    monkeypatch.setattr(knn, "checkpointed", lambda df, purpose: (kept := keep(df, purpose), loads.append(kept) if purpose == "bin-loads" else None)[0])
    rng = np.random.default_rng(5)
    donors = spark.createDataFrame(pd.DataFrame({"donor_id": np.arange(2000), "v": rng.random(2000)})).select("donor_id", F.array("v").alias("y"))
    requests = spark.createDataFrame(pd.DataFrame({"request_id": np.arange(400), "v": rng.random(400)})).select(
        "request_id", F.array("v").alias("x"), F.lit(-1).alias("target"))
    assert knn.knn_join(requests, donors, 1, 3).where("size(donors) = 3").count() == 400
    assert [r["copies"] for r in loads[0].collect()] == [1]
