import pytest
from pyspark.sql import functions as F, types as T

from hydrofold import fixtures
from hydrofold.plans import report
from hydrofold.schema import sample_schema
from hydrofold.session import workspace
from hydrofold.sources import folders, tables
from hydrofold.streaming import metrics as stream

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def test_source_folder_provenance_and_errors(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "two.csv").write_text("a,b\nbad,z\n")
    (tmp_path / "four.csv").write_text("a,b\n")
    (tmp_path / "three.csv.gz").write_bytes(b"not gzip at all")
    rows = tables.scan_source_folder(spark, str(tmp_path), SCHEMA, strict=False)
    got = {(r["Database_name"], r["a"], r["b"]) for r in rows.select("Database_name", "a", "b").collect()}
    assert got == {("one", 1, "x"), ("one", 2, "y"), ("two", None, "z")}
    rows.cache()
    assert rows.where("_corrupt_record is not null").count() == 1
    assert [r["Database_name"] for r in tables.unreadable_files(spark, str(tmp_path), rows, SCHEMA).collect()] == ["three"]


def test_source_folder_rejects_other_headers(spark, tmp_path):
    (tmp_path / "one.csv").write_text("b,a\nx,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.scan_source_folder(spark, str(tmp_path), SCHEMA).collect()


def test_latest_snapshot(spark, tmp_path):
    for name, n in (("2025-01-01", 5000), ("2025-02-01", 10)):
        tables.write_snapshot(spark.range(n), str(tmp_path), name)
    assert folders.latest_snapshot(spark, str(tmp_path)).endswith("2025-02-01")
    assert folders.latest_snapshot(spark, str(tmp_path), by="mtime").endswith("2025-02-01")
    assert folders.latest_snapshot(spark, str(tmp_path), min_bytes=5000).endswith("2025-01-01")
    with pytest.raises(FileNotFoundError):
        folders.latest_snapshot(spark, str(tmp_path), min_bytes=10 ** 9)


def test_scan_prunes_and_pushes_down(spark, tiny):
    df = tables.scan_pruned(fixtures.samples(spark, tiny), ["na", "cl"]).where("na > 100")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(na,100.0)" in plan and "hco3" not in plan


def test_csv_samples_round_trip(spark, tmp_path):
    row = tuple(None if not isinstance(f.dataType, T.StringType) else "x" for f in sample_schema().fields)
    spark.createDataFrame([row], sample_schema()).write.option("header", True).csv(str(tmp_path / "s.csv"))
    assert tables.scan_samples(spark, str(tmp_path / "s.csv")).first()["location"] == "x"


def test_quality_filter_keeps_the_error_column(spark, tiny):
    root, target = workspace(spark, "t"), workspace(spark, "t")
    tables.write_snapshot(fixtures.samples(spark, tiny), root, "1")
    done = report.quality_filter(spark, root, target, "1", fixtures.BALANCE_COLUMNS, "temperature")
    counted = done.report.first()
    assert done.table.count() == counted["kept"] == 206 and counted["original"] == 1000
    assert done.table.where(F.abs("ibe") > 5).count() == 0


def test_consolidation_matches(spark):
    a = spark.createDataFrame([("w", 1.0, 2.0), ("v", None, 3.0)], "well_or_spring_name string, WGS84_latitude double, WGS84_longitude double")
    done = report.consolidate(spark, {"A": a, "B": a}, workspace(spark, "t"), "1")
    assert done.reconciliation.where("not matches").count() == 0 and done.table.count() == 4
    assert done.points.where("cell = 0").first()["n"] == 2


def result_rows(spark, values):
    return spark.createDataFrame([("na", float(o), float(i), "Test", 1, "na") for o, i in values], tables.RESULT_SCHEMA)


def test_stream_picks_up_changed_runs_once(spark, tmp_path):
    folder, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    tables.write_result_csv(result_rows(spark, [(1, 1), (2, 3)]), folder, "000_Base")
    stream.stream_imputation_metrics(spark, folder, target, state)
    assert stream.current_metrics(spark, target).first()["n"] == 2
    stream.stream_imputation_metrics(spark, folder, target, state)
    assert stream.current_metrics(spark, target).first()["n"] == 2
    tables.write_result_csv(result_rows(spark, [(2, 2), (3, 4), (4, 4)]), folder, "000_Base")  # a new version, not more rows
    assert stream.run_until_complete(spark, folder, target, state, str(tmp_path / "DONE")) is None
    (tmp_path / "DONE").write_text("")
    summary = stream.run_until_complete(spark, folder, target, state, str(tmp_path / "DONE")).collect()
    rows = stream.current_metrics(spark, target).collect()
    assert [(r["run_id"], r["level"], r["n"]) for r in rows] == [("000_Base", 1, 3)]
    assert [r["run_id"] for r in summary] == ["000_Base"] and summary[0]["avg_rmse"] == pytest.approx((1 / 3) ** 0.5)
