"""Queries that compare imputers score every complete row, training rows included."""

import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from hydrofold.fixtures import BASE, samples
from hydrofold.plans import imputation as study


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("events"))
    at = datetime.datetime(2024, 1, 1)
    events = [(i, at, i % 7, "view", round(0.37 * (i * 37 % 101) + 1.0, 2), "{}") for i in range(160)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    spark.createDataFrame([(i, f"nation {i}") for i in range(25)], "n_nationkey long, n_name string").write.parquet(f"{d}/nation.parquet")
    return d


def complete_ids(spark, folder):
    return {r[0] for r in samples(spark, folder).dropna("any", subset=BASE).select("sample_id").collect()}


def test_neighbours_are_searched_for_every_complete_row(spark, folder):
    rows = contract.queries()["mask_benchmark_knn"](spark, folder).select("sample_id", "split", "combination").toPandas()
    assert set(rows["sample_id"]) == complete_ids(spark, folder) and set(rows["split"]) == {"Test", "Train"}
    assert (rows.drop_duplicates().groupby("sample_id").size() == 62).all()  # every mask of six columns


def test_imputers_are_compared_on_every_complete_row(spark, folder, monkeypatch):
    scored = {}

    def compare(models):
        scored.update({name: {r[0] for r in rows.select("sample_id").distinct().collect()} for name, rows in models.items()})
        return spark.range(1).select(F.lit(1).alias("level"))

    monkeypatch.setattr(study.evaluation, "compare_imputers", compare)
    contract.queries()["imputer_comparison"](spark, folder)
    assert scored == dict.fromkeys(("VAE", "kNN"), complete_ids(spark, folder))
