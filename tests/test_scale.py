"""What keeps large tables from the driver and the slow paths: plans of the imputation queries on rows made here."""

import random

from pyspark.sql import functions as F

from hydrofold.catalog.imputation import visible_mean_imputer
from hydrofold.operators import benchmark, clusters, evaluation
from hydrofold.sources import tables

COLUMNS = ["a", "b", "c"]


def gappy(spark, n=120):
    rng = random.Random(4)
    rows = [(i, *[rng.random() if rng.random() < 0.8 else None for _ in COLUMNS]) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id long, a double, b double, c double")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_masks_are_applied_without_lambdas_and_rows_are_the_same(spark):
    df = gappy(spark)
    found = benchmark.mask_benchmark(df, "sample_id", COLUMNS, lambda train: visible_mean_imputer(COLUMNS), include_incomplete=True)
    assert "lambda" not in plan_of(found)
    _, scaling = benchmark.prepared(df, "sample_id", COLUMNS, include_incomplete=True)
    want = {}
    for row in df.collect():
        z = [None if row[c] is None else (row[c] - m) / s for c, m, s in zip(COLUMNS, scaling.mean, scaling.scale)]
        for mask in range(1, 7):
            seen = [v for j, v in enumerate(z) if v is not None and not mask >> j & 1]
            guess = sum(seen) / len(seen) if seen else 0.0
            names = tuple(c for j, c in enumerate(COLUMNS) if mask >> j & 1)
            for j, c in enumerate(COLUMNS):
                if mask >> j & 1 and z[j] is not None:
                    want[row["sample_id"], names, c] = (row[c], round(guess * scaling.scale[j] + scaling.mean[j], 9))
    got = {(r["sample_id"], tuple(r["combination"]), r["feature"]): (r["original"], round(r["imputed"], 9)) for r in found.collect()}
    assert got == want


def test_densities_do_not_broadcast_the_values(spark):
    """Few bytes of input that a generator turns into many rows: the groups are the side to broadcast."""
    rows = spark.range(2000).select(F.inline(F.array(*[F.struct(F.lit(f"f{i % 3}").alias("feature"), (F.col("id") * (i + 1) % 97 / 10.0).alias("original"),
                                                               (F.col("id") * (i + 2) % 89 / 10.0).alias("imputed")) for i in range(30)])))
    found = evaluation.imputation_density(rows, ["feature"], points=20)
    assert found.count() == 3 * 2 * 20
    plan = found._jdf.queryExecution().sparkPlan().toString()
    for at in (i for i, line in enumerate(plan.split("\n")) if "BroadcastHashJoin" in line and "_box" not in line):
        line = plan.split("\n")[at]
        if "feature" in line and "series" in line and "point" not in line:
            assert "BuildRight" in line, line


def test_waves_of_results_are_compressed_and_kept_once(spark, tmp_path):
    row = ("f", 1.0, 2.0, "Test", 1, "f")
    df = spark.createDataFrame([row], "Feature string, Original double, Imputed double, Split string, Masking_Level int, Masked_Combination string")
    tables.write_result_csv(df, str(tmp_path / "in"), "000_Base")
    assert list((tmp_path / "in").rglob("*.csv.gz")) and not list((tmp_path / "in").rglob("*.csv"))


def test_density_agrees_with_the_direct_sum(spark):
    values = [(("x" if i % 2 else "y"), float(i % 13)) for i in range(200)]
    found = clusters.density(spark.createDataFrame(values, "feature string, value double"), ["feature"], 5).collect()
    assert len(found) == 10 and all(r["density"] > 0 for r in found)


def test_scores_of_requests_are_those_of_their_cells(spark):
    df = gappy(spark).unionByName(spark.sql("SELECT 500L AS sample_id, 2.5D AS a, CAST(NULL AS DOUBLE) AS b, 0.5D AS c"))
    flat = df.withColumn("c", F.when(F.col("c").isNotNull(), F.lit(7.1)))
    for table in (df, flat, df.limit(0)):
        make = lambda by: benchmark.mask_benchmark(
            table, "sample_id", COLUMNS, lambda train: visible_mean_imputer(COLUMNS), include_incomplete=True, by_request=by)  # noqa: B023
        for keys in (["level", "combination"], ["split", "level", "combination"]):
            by_cell, by_request = ({tuple(str(r[k]) for k in keys): (r["n"], r["rmse"], r["r2"]) for r in evaluation.imputation_metrics(
                make(by), keys, min_count=2).collect()} for by in (False, True))
            assert by_cell.keys() == by_request.keys() and (len(by_cell) >= 6 or table not in (df, flat))
            for k, (n, rmse, r2) in by_cell.items():
                got = by_request[k]
                assert got[0] == n and abs(got[1] - rmse) < 1e-12 and abs(got[2] - r2) < 1e-9, k
        one, other = ([tuple(r) for r in evaluation.compare_imputers({"m": make(by)}).orderBy("level").collect()] for by in (False, True))
        assert len(one) == len(other) and all(abs(a - b) < 1e-9 for x, y in zip(one, other) for a, b in zip(x, y))
