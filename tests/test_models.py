import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hydrofold import fixtures
from hydrofold.functions.normal import inverse_normal
from hydrofold.operators import benchmark, clusters, completeness, evaluation, features, som, vae
from hydrofold.plans import imputation, maps
from hydrofold.plans.preprocess import preprocess


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 4, 800)
    pdf = pd.DataFrame({"id": np.arange(800), "a": centre % 2 + 0.05 * rng.normal(size=800), "b": centre // 2 + 0.05 * rng.normal(size=800),
                        "c": rng.normal(size=800)})
    return spark.createDataFrame(pdf).repartition(4).persist(), pdf


def test_inverse_normal():
    from statistics import NormalDist
    p = np.concatenate([np.linspace(1e-7, 1 - 1e-7, 999), [0.0749, 0.0751, 1e-12]])
    assert np.allclose(inverse_normal(p), [NormalDist().inv_cdf(v) for v in p], rtol=0, atol=1e-13)


def test_normal_scores(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.exponential(3, 400), 1)
    df = spark.createDataFrame([(i, float(x) if i % 9 else None) for i, x in enumerate(v)], "id int, v double").withColumn("few", F.when(F.col("id") < 5, 1.0))
    out, names = features.gaussianize(df, ["v", "few"])
    assert names == ["v_gauss"]
    got = out.orderBy("id").toPandas()
    known = got["v"].dropna().to_numpy()
    grid, refs = np.quantile(known, np.linspace(0, 1, len(known))), np.linspace(0, 1, len(known))
    p = 0.5 * (np.interp(known, grid, refs) - np.interp(-known, -grid[::-1], -refs[::-1]))
    p = np.where(known <= grid[0], 0, np.where(known >= grid[-1], 1, p))
    assert np.allclose(got["v_gauss"].dropna(), inverse_normal(np.clip(p, 1e-7, 1 - 1e-7)), atol=1e-6)
    assert got["v_gauss"].isna().equals(got["v"].isna())


def test_select_features_prefers_logs():
    chosen, report = features.select_features(["a", "a_gauss", "a_log_gauss", "b", "b_gauss", "c"], ["a", "b", "c", "d"])
    assert chosen == ["a_log_gauss", "b_gauss", "c"] and report["d"] is None


def test_preprocess_columns(spark, tiny):
    df, mapping = preprocess(fixtures.samples(spark, tiny), ["na", "ph"], ["rock_type", "period"], "period", "sample_id")
    assert df.columns == ["sample_id", "rock_type", "period", "na", "ph", "na_log_gauss", "ph_gauss"]
    assert mapping == {"na": "na_log_gauss", "ph": "ph_gauss"}
    assert df.where("period = 'Unknown'").count() == 0


def test_pca_against_numpy(blobs):
    df, pdf = blobs
    c = features.pca(df, ["a", "b", "c"])
    x = pdf[["a", "b", "c"]].to_numpy()
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(c.variances, values[::-1][:2])
    assert np.allclose(np.abs(c.directions @ vectors[:, ::-1][:, :2]), np.eye(2), atol=1e-8)


def test_map_training_improves_and_repeats(blobs):
    df, _ = blobs
    rows = maps.map_rows(df, ["a", "b"])
    start = som.plane_codebook(rows, ["a_s", "b_s"], 3, 3)
    error = lambda book: som.som_quality(som.som_assign(rows, book)).first()["quantization_error"]
    book = som.som_fit(rows, ["a_s", "b_s"], 3, 3, epochs=8, start=start)
    again = som.som_fit(rows.repartition(7), ["a_s", "b_s"], 3, 3, epochs=8, start=start)
    assert error(book) < error(start)
    assert np.allclose(book.weights, again.weights, atol=1e-9)
    larger = som.som_fit(rows, ["a_s", "b_s"], 5, 5, epochs=8)
    assert error(larger) < error(book)


def test_online_map(blobs):
    df, _ = blobs
    rows = features.min_max_scale(df, features.min_max(df, ["a", "b"]), "_s").select("id", "a_s", "b_s").persist()
    error = lambda book: som.som_quality(som.som_assign(rows, book)).first()["quantization_error"]
    batch = som.som_fit(rows, ["a_s", "b_s"], 3, 3)
    for shard_rows in (8192, 150):
        fit = lambda table: som.som_fit_online(table, "id", ["a_s", "b_s"], 3, 3, steps=8000, rounds=8, shard_rows=shard_rows)  # noqa: E731, B023
        book = fit(rows)
        assert error(book) < 1.05 * error(batch)
        again = fit(rows.repartition(7, "b_s").withColumn("id", F.col("id").cast("string")))
        assert (book.weights == again.weights).all()
    gaps = rows.unionByName(rows.limit(3).withColumn("a_s", F.lit(None).cast("double")))
    few = lambda table: som.som_fit_online(table, "id", ["a_s", "b_s"], 2, 2, steps=1, rounds=2, start=som.grid_codebook(["a_s", "b_s"], 2, 2)).weights
    assert (few(gaps) == few(rows)).all()
    keyless = rows.withColumn("id", F.when(F.col("id") % 2 == 0, F.col("id")))
    assert np.isfinite(few(keyless.unionAll(keyless))).all()
    with pytest.raises(ValueError, match="no rows"):
        som.som_fit_online(rows.limit(0), "id", ["a_s", "b_s"], 2, 2)


def test_online_steps_are_the_plain_rule():
    rng = np.random.default_rng(1)
    rows, book = rng.random((30, 3)), som.grid_codebook(["a", "b", "c"], 3, 2)
    p = book.positions()
    rate, sigma = som.Decay().at(np.linspace(0, 1, 30))
    assert np.allclose([rate[0], rate[-1], sigma[0], sigma[-1]], [0.9, 0.01, 2, 1 / 3])
    got, mass = som.online_steps(book.weights, rows, ((p[:, None] - p[None]) ** 2).sum(axis=2), rate, sigma)
    w, total = book.weights.copy(), np.zeros(6)
    for x, a, s in zip(rows, rate, sigma):
        best = min(range(6), key=lambda c: sum((x - w[c]) ** 2))
        for c in range(6):
            h = a * math.exp(-sum((p[c] - p[best]) ** 2) / (2 * s * s))
            w[c] += h * (x - w[c])
            total[c] += h
    assert np.allclose(got, w) and np.allclose(mass, total)


def test_hexagonal_neighbours():
    near = som.grid_codebook(["a"], 3, 3).neighbours()
    assert near[4].sum() == 6 and (near == near.T).all()


def test_map_analysis_and_sweep(blobs):
    df, _ = blobs
    table = df.withColumns({"temperature": F.lit(20.0), "rock_type": F.when(F.col("a") > 0.5, "Granite").otherwise("Chalk")})
    report = maps.som_analysis(table, ["a", "b"], ["a", "b", "c"], 2, 2, epochs=6)
    assert report.means.count() == 4 and report.assigned.count() == 800
    top = report.profile.where("rank = 1").toPandas()
    assert set(top["feature"]) <= {"a", "b"} and (top["p_value"] < 1e-6).all()
    assert maps.som_analysis(table.limit(10), ["a"], ["a"], 2, 2) is None
    assert maps.som_sweep(table, {"ab": ["a", "b"], "none": ["c"]}, (2,), 3).count() == 2


def test_rank_test_against_definition(blobs):
    df, pdf = blobs
    pdf = pdf.assign(v=pdf["c"].round(1), som_x=(pdf["a"] > 0.5).astype(int), som_y=0)
    sdf = df.select("id", F.round("c", 1).alias("v"), (F.col("a") > 0.5).cast("int").alias("som_x"), F.lit(0).alias("som_y"))
    got = clusters.p_value(clusters.mann_whitney(sdf, ["v"])).toPandas().set_index("som_x")
    for cell, part in pdf.groupby("som_x"):
        n1, n2 = len(part), len(pdf) - len(part)
        ranks = pdf["v"].rank()
        u = ranks[part.index].sum() - n1 * (n1 + 1) / 2
        t = pdf["v"].value_counts().to_numpy(float)
        sd = math.sqrt(n1 * n2 / 12 * (len(pdf) + 1 - (t ** 3 - t).sum() / (len(pdf) * (len(pdf) - 1))))
        z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd
        assert got.loc[cell, "u"] == pytest.approx(u) and got.loc[cell, "score"] == pytest.approx(z)
        assert got.loc[cell, "p_value"] == pytest.approx(min(1.0, math.erfc(z / math.sqrt(2))))


def test_forest_importances(blobs):
    df, _ = blobs
    table = df.select("a", "b", "c", (F.col("a") > 0.5).cast("int").alias("som_x"), F.lit(0).alias("som_y"))
    overall = {r["feature"]: r["importance"] for r in clusters.rf_importance_global(table, ["a", "b", "c"], trees=20).collect()}
    assert sum(overall.values()) == pytest.approx(1.0) and max(overall, key=overall.get) == "a" and min(overall.values()) >= 0
    local = clusters.top_importances(clusters.rf_importance_local(table, ["a", "b", "c"], trees=10), 1).collect()
    assert [r["feature"] for r in local] == ["a", "a"]


def test_density_integrates_to_one(blobs):
    df, _ = blobs
    rows = clusters.kde(df.withColumns({"som_x": F.lit(0), "som_y": F.lit(0)}), ["c"], points=200, linear=["c"]).orderBy("point").toPandas()
    assert np.trapezoid(rows["density"], rows["x"]) == pytest.approx(1.0, abs=0.02)


def test_density_is_the_direct_sum(spark):
    rng = np.random.default_rng(4)
    groups = {0: np.round(rng.normal(size=500), 1), 1: np.concatenate([rng.normal(size=60), [40.0, 41.0]]), 2: np.array([1.0, 1.0]), 3: np.array([2.0] * 5)}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [(0, None)], "g int, value double").repartition(3)
    for tails in (0.0, 3.0):
        got = clusters.density(df, ["g"], 50, tails=tails).orderBy("g", "point").toPandas()
        assert set(got["g"]) == {0, 1}
        for g, part in got.groupby("g"):
            v = groups[g]
            h = v.std(ddof=1) * len(v) ** -0.2
            x = np.linspace(v.min() - tails * h, v.max() + tails * h, 50)
            want = np.exp(-0.5 * ((x[:, None] - v[None]) / h) ** 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))
            assert np.allclose(part["x"], x) and np.allclose(part["density"], want, rtol=0, atol=1e-12) and (part["n"] == len(v)).all()


def test_drawn_latent_does_not_depend_on_batches(spark):
    model = vae.VaeModel(("a", "b"), vae.VaeParams(latent_dim=2, hidden_dim=4, enc_layers=1, dec_layers=1),
                         vae.initial_weights(vae.VaeParams(latent_dim=2, hidden_dim=4, enc_layers=1, dec_layers=1), 2))
    df = spark.createDataFrame([(i, None if i % 3 else 1.0, 0.5) for i in range(200)] + [(None, None, 0.5)], "id long, a double, b double")
    before, found = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), []
    try:
        for partitions, batch in ((1, "10000"), (5, "7")):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            found.append(sorted(vae.vae_impute(df.repartition(partitions), "id", model, sample_latent=True).collect(), key=lambda r: (r["id"] is None, r["id"])))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found[0] == found[1] and len({r["a"] for r in found[0] if r["id"] and r["id"] % 3}) > 100


def test_gradient():
    p = vae.VaeParams(latent_dim=2, hidden_dim=8, enc_layers=2, dec_layers=2)
    rng = np.random.default_rng(0)
    theta = np.stack([vae.initial_weights(p, 3), rng.normal(size=len(vae.initial_weights(p, 3))) * 0.3])
    x, noise, weight = rng.normal(size=(5, 3)), rng.normal(size=(2, 5, 2)), np.array([[1, 1, 1, 1, 1], [1, 0, 1, 0, 1.0]])
    _, gradient = vae.loss_and_gradient(theta, x, noise, weight, p)
    for m in (0, 1):
        for i in rng.choice(theta.shape[1], 40, replace=False):
            step = np.zeros_like(theta)
            step[m, i] = 1e-6
            up, down = (vae.loss_and_gradient(theta + s * step, x, noise, weight, p, False)[0] for s in (1, -1))
            assert gradient[m, i] == pytest.approx((up - down)[m] / 2e-6, rel=1e-4, abs=1e-5)
            assert (up - down)[1 - m] == 0.0


def test_autoencoder_beats_the_mean_and_repeats(spark, tiny):
    df = fixtures.samples(spark, tiny)
    params = vae.VaeParams(epochs=100, sync_every=20)
    model = imputation.train_vae(df, "sample_id", fixtures.BASE, params, folds=2)
    again = imputation.train_vae(df, "sample_id", fixtures.BASE, params, folds=2)
    assert np.allclose(model.weights, again.weights, atol=1e-9)
    assert model.loss_history[-1] < model.loss_history[0] and len(model.fold_scores) == 2
    document = imputation.run_document(spark, 3, "Base", fixtures.BASE, {"na": "na"}, model, 0.02)
    restored = imputation.model_of(document.first())
    assert np.array_equal(restored.weights, model.weights) and restored.bounds == model.bounds
    scores = evaluation.imputation_metrics(imputation.vae_benchmark(df, "sample_id", restored).where("level = 1"), ["level"]).first()
    mean = benchmark.mask_benchmark(df, "sample_id", fixtures.BASE, lambda t: benchmark.mean_imputer(fixtures.BASE)).where("level = 1")
    assert scores["rmse"] < 0.8 * evaluation.imputation_metrics(mean, ["level"]).first()["rmse"]
    filled = vae.vae_impute(df.where("ca is not null").select("sample_id", *fixtures.BASE), "sample_id", model)
    assert filled.where(" or ".join(f"{c} is null" for c in fixtures.BASE)).count() == 0
    assert imputation.train_vae(df.limit(20), "sample_id", fixtures.BASE, params) is None


def test_weights_do_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(900, 3)), columns=["a", "b", "c"]).assign(id=np.arange(900))
    params = vae.VaeParams(latent_dim=2, hidden_dim=8, enc_layers=2, dec_layers=2, epochs=6, sync_every=3, shard_rows=250)
    before, found = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), []
    try:
        for partitions, batch in ((1, "10000"), (2, "10000"), (8, "50")):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            found.append(vae.vae_fit(spark.createDataFrame(pdf).repartition(partitions), "id", ["a", "b", "c"], params, folds=2))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for other in found[1:]:
        assert np.allclose(found[0].weights, other.weights, rtol=0, atol=1e-9) and np.allclose(found[0].fold_scores, other.fold_scores)
        assert np.allclose(found[0].loss_history, other.loss_history) and len(other.loss_history) == 6


def test_one_stage_equals_round_by_round(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(rng.normal(size=(900, 4)), columns=["a", "b", "c", "d"]).assign(id=np.arange(900))
    df = spark.createDataFrame(pdf)
    p = vae.VaeParams(latent_dim=2, hidden_dim=8, enc_layers=2, dec_layers=2, epochs=7, sync_every=3, shard_rows=100)
    one, jobs = (vae.vae_fit(df, "id", ["a", "b", "c"], p, folds=2, task_rows=rows) for rows in (vae.TASK_ROWS, 1))
    assert np.allclose(one.weights, jobs.weights, rtol=0, atol=1e-9) and np.allclose(one.loss_history, jobs.loss_history)
    assert np.allclose(one.fold_scores, jobs.fold_scores) and np.allclose(one.fold_masked_scores, jobs.fold_masked_scores)
    assert one.n_samples == jobs.n_samples == 900
    # sets of other widths, sizes and lengths in the same rounds are what they are by themselves
    longer = vae.VaeParams(latent_dim=3, hidden_dim=16, enc_layers=1, dec_layers=2, epochs=10, sync_every=4, shard_rows=250)
    sets = [vae.Training(df, "id", ("a", "b", "c"), p, 2), vae.Training(df.where("id < 0"), "id", ("a",), p), vae.Training(df.where("id < 600"), "id", ("a", "b", "c", "d"), longer, 0)]
    first, none, third = vae.vae_fit_sets(sets)
    alone = vae.vae_fit(sets[2].rows, "id", ["a", "b", "c", "d"], longer)
    assert none is None and np.allclose(first.weights, one.weights, rtol=0, atol=1e-9) and np.allclose(third.weights, alone.weights, rtol=0, atol=1e-9)
    assert len(third.loss_history) == 10 and third.n_samples == 600 and third.fold_scores == ()


def test_study_over_available_sets(spark, tiny):
    from hydrofold.catalog.features import SHORT
    from hydrofold.schema import BASE_FEATURES
    df = fixtures.samples(spark, tiny)
    sets = imputation.available_sets(df, list(BASE_FEATURES), resolve=SHORT.get, max_extra=1)
    assert sets["Base_without_pH"] == fixtures.BASE and all(len(c) == 7 for label, c in sets.items() if label != "Base_without_pH") and len(sets) > 2
    p = vae.VaeParams(epochs=4, sync_every=2)
    documents = {r["run_id"].split("_", 1)[1]: r for r in imputation.imputation_study(df, "sample_id", sets, p, folds=2).collect()}
    assert set(documents) == set(sets)
    for label, columns in sets.items():
        alone = imputation.train_vae(df, "sample_id", columns, p, folds=2)
        found = imputation.model_of(documents[label])
        assert np.allclose(found.weights, alone.weights, rtol=0, atol=1e-9) and found.bounds == alone.bounds
        assert np.allclose(found.scaling.mean, alone.scaling.mean) and np.allclose(found.scaling.scale, alone.scaling.scale)
    assert imputation.available_sets(df, list(BASE_FEATURES), resolve=SHORT.get, min_rows=10 ** 9) == {}
    assert imputation.imputation_study(df.limit(10), "sample_id", sets, p).count() == 0


def test_exact_rank_test():
    from itertools import combinations
    for n1, n2 in ((3, 4), (5, 3), (2, 6)):
        us = [sum(p) - n1 * (n1 - 1) // 2 for p in combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 + 1):
            assert clusters.exact_p(n1, n2, u) == pytest.approx(min(1, 2 * sum(x >= max(u, n1 * n2 - u) for x in us) / len(us)))


def test_forests_need_rows_and_clusters(spark):
    rows = [(0, i % 2, float(i), float(-i)) for i in range(12)]
    df = spark.createDataFrame(rows, "som_x int, som_y int, a double, b double")
    assert clusters.rf_importance_global(df.limit(9), ["a", "b"]).count() == 0
    assert clusters.rf_importance_global(df.where("som_y = 1").unionAll(df.where("som_y = 1")), ["a", "b"]).count() == 0
    assert clusters.rf_importance_global(df, ["a", "b"], trees=5).count() == 2


def test_study_report(spark, tiny):
    df = fixtures.samples(spark, tiny)
    params = vae.VaeParams(epochs=10, sync_every=10)
    report = imputation.imputation_report(df, "sample_id", {"Base": fixtures.BASE}, params, folds=2)
    assert report.documents.count() == 1 and report.plan.first()["hidden_dim"] >= 32
    assert report.metrics.select("level").distinct().count() == 5
    assert report.summary.first()["run_id"] == "000_Base" and report.summary.first()["features"] == 6


def test_metrics_edge_cases(spark):
    rows = [("x", 1.0, 1.0), ("x", 1.0, 1.0), ("y", 1.0, 2.0), ("y", 1.0, 1.0), ("z", 1.0, 1.0), ("w", 0.0, 0.5), ("w", 1.0, 0.5)]
    df = spark.createDataFrame(rows, "k string, original double, imputed double")
    got = {r["k"]: (r["n"], r["rmse"], r["r2"]) for r in evaluation.imputation_metrics(df, ["k"], min_count=2).collect()}
    assert got == {"x": (2, 0.0, 1.0), "y": (2, math.sqrt(0.5), 0.0), "w": (2, 0.5, 0.0)}


def test_beam_against_enumeration(spark, tiny):
    from itertools import combinations
    columns = ["na", "mg", "fe", "ph", "temperature"]
    pdf = fixtures.samples(spark, tiny).select(columns).toPandas().notna()
    got = completeness.completeness_beam(fixtures.samples(spark, tiny), columns).toPandas()
    for size in range(1, 6):
        best = max(int(pdf[list(c)].all(axis=1).sum()) for c in combinations(columns, size))
        assert got[(got["size"] == size) & (got["place"] == 1)]["n"].iloc[0] == best


def test_inference_makes_no_slopes_and_gives_the_same_bits():
    """Slopes serve gradients only; the activation is the same with and without them."""
    rng = np.random.default_rng(3)
    p = vae.VaeParams()
    theta = np.stack([vae.initial_weights(p, 5)] * 2)
    layers = vae._views(theta, p, 5)[:p.enc_layers]
    x = rng.normal(size=(40, 5))
    plain, slopes = x, []
    for w, b in layers:
        plain = plain @ w + b
        slopes.append(np.where(plain > 0, 1.0, vae.LEAK))
        plain = plain * slopes[-1]
    with_slopes, trace = vae._stack(x, layers)
    without, bare = vae._stack(x, layers, False)
    assert np.array_equal(plain, with_slopes) and np.array_equal(plain, without)
    assert all(np.array_equal(a, b) for a, (_, b) in zip(slopes, trace)) and all(s is None for _, s in bare)


def test_best_cells_are_those_of_the_plain_distances(monkeypatch):
    rng = np.random.default_rng(3)
    rows = rng.random((3000, 3))
    rows[:400] = np.round(rows[:400] * 4) / 4  # halfway between cells of the even map
    rows[400], rows[401] = 1e9, [np.inf, 0.0, 0.0]
    plain, decided = som._distances, []
    monkeypatch.setattr(som, "_distances", lambda some, weights: decided.append(len(some)) or plain(some, weights))
    for weights in (np.zeros((1, 3)), np.zeros((5, 3)), som.grid_codebook(["a", "b", "c"], 3, 3).weights, rng.random((100, 3)), rng.random((400, 3))):
        d = plain(rows, weights)
        first = d.argmin(axis=1)
        d[np.arange(len(d)), first] = np.inf
        decided.clear()
        got, second = som._best_cells(np.ascontiguousarray(rows.T), weights, second=True)
        assert (got == first).all() and (second == d.argmin(axis=1)).all()
        assert (som._best_cells(np.ascontiguousarray(rows.T), weights)[0] == first).all()
        if len(weights) == 100:  # all but a few rows are decided without their distances
            assert sum(decided) < 50
