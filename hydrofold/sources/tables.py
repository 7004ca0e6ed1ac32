"""Reading sample tables and writing snapshots, benchmark results and run metadata."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import q, sample_schema

RESULT_SCHEMA = T.StructType([
    T.StructField("Feature", T.StringType()), T.StructField("Original", T.DoubleType()),
    T.StructField("Imputed", T.DoubleType()), T.StructField("Split", T.StringType()),
    T.StructField("Masking_Level", T.IntegerType()), T.StructField("Masked_Combination", T.StringType()),
])

METADATA_SCHEMA = """run_id string, run_index int, label string, features_user array<string>, features_mapped array<string>,
mapping_report map<string,string>, n_samples long, final_loss double, latent_dim int, enc_layers int, dec_layers int,
hidden_dim int, cv_score double, cv_masked_score double, cv_fold_scores array<double>, cv_masked_fold_scores array<double>,
cv_params struct<n_splits:int, test_size_global:double, shuffle:boolean>, epochs_trained int, batch_size int,
kld_weight double, training_loss_history array<double>, quantile_clipping struct<active:boolean, threshold:double,
lower:array<double>, upper:array<double>>, mean array<double>, scale array<double>, weights array<double>"""


def scan_samples(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A consolidated sample table: Parquet, or CSV with a header and a declared schema."""
    if path.rstrip("/").endswith(".parquet") or schema is None and ".csv" not in path:
        return spark.read.parquet(path)
    return spark.read.schema(schema or sample_schema()).option("header", True).csv(path)


def scan_source_folder(spark: SparkSession, folder: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Every CSV of a folder with its file stem as ``Database_name``; malformed lines are kept in ``_corrupt_record``.

    Strict, for merging: a header that differs from the schema in names or order, or an unreadable file, fails
    the read. Lenient, for reports: such a file is skipped here and named by ``unreadable_files``.
    """
    declared = T.StructType([f for f in schema.fields if f.name not in ("Database_name", "_corrupt_record")])
    reader = (spark.read.schema(declared.add("_corrupt_record", T.StringType())).option("header", True)
              .option("enforceSchema", False).option("mode", "PERMISSIVE")
              .option("ignoreCorruptFiles", not strict).option("pathGlobFilter", "*.csv*").option("recursiveFileLookup", True))
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv(\.[a-z0-9]+)?$", "")
    return reader.csv(folder).select("*", name.alias("Database_name"))


def unreadable_files(spark: SparkSession, folder: str, rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Files of the folder that gave no row although they should, as error entries; only names and lengths are listed.

    A file that has the schema's header and nothing else is in order.
    """
    names = [f.name for f in schema.fields if f.name not in ("Database_name", "_corrupt_record")]
    stem = lambda path: F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.csv(\.[a-z0-9]+)?$", "")
    lines = (spark.read.option("ignoreCorruptFiles", True).option("pathGlobFilter", "*.csv*").option("recursiveFileLookup", True).text(folder)
             .select("value", stem(F.col("_metadata.file_path")).alias("Database_name")).where(F.trim("value") != ""))
    header_only = lines.groupBy("Database_name").agg(F.count("*").alias("n"), F.min("value").alias("first")).where(
        (F.col("n") == 1) & (F.regexp_replace("first", "[\" \r\ufeff]", "") == ",".join(names).replace(" ", ""))).select("Database_name")
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv*").option("recursiveFileLookup", True).load(folder)
              .select(stem(F.col("path")).alias("Database_name"), "length"))
    return listed.join(rows.select("Database_name").distinct().unionByName(header_only), "Database_name", "left_anti")


def scan_pruned(df: DataFrame, name_contains: Iterable[str]) -> DataFrame:
    """Only the columns whose name contains one of the texts; Parquet then reads no others."""
    texts = list(name_contains)
    return df.select([q(c) for c in df.columns if any(t in c for t in texts)])


def select_by_pattern(df: DataFrame, patterns: dict[str, str], keep: Iterable[str] = ()) -> DataFrame:
    """Per output name the first column whose name matches a regular expression."""
    import re

    found = {}
    for name, pattern in patterns.items():
        match = next((c for c in df.columns if re.search(pattern, c)), None)
        if match is not None:
            found[name] = match
    return df.select([q(c) for c in keep] + [q(c).alias(name) for name, c in found.items()])


def write_snapshot(df: DataFrame, root: str, stamp: str, partition_by: Iterable[str] = ()) -> str:
    """Write one snapshot of a table as Parquet under its time stamp."""
    path = f"{root.rstrip('/')}/{stamp}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def write_results(df: DataFrame, root: str) -> None:
    """Benchmark rows by model, run and masking level; values are stored with four decimals.

    What is there of the same model, run and level is replaced, so a job that runs again doubles nothing.
    """
    rounded = df.withColumns({c: F.round(q(c), 4) for c in ("Original", "Imputed")})
    # One shuffle key per (run, level) would make few huge files, so rows stay where they are.
    rounded.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "run_id", "Masking_Level").parquet(root)


def write_result_csv(df: DataFrame, root: str, run_id: str) -> None:
    """Benchmark rows of one run as compressed CSV files, in a folder for each level named after both; levels in ``df`` are replaced."""
    rounded = df.withColumns({c: F.round(q(c), 4) for c in ("Original", "Imputed")})
    folder = F.concat(F.lit(f"Imputation_Results_Run_{run_id}_Level_"), F.col("Masking_Level").cast("string"))
    rounded.select(*RESULT_SCHEMA.names, folder.alias("result")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").option("header", True).option("compression", "gzip").partitionBy("result").csv(root)


def write_run_metadata(df: DataFrame, root: str) -> None:
    """Nested run documents, one JSON line per trained model; a run that is there already is replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(root)


def read_run_metadata(spark: SparkSession, root: str, run_index: int | None = None) -> DataFrame:
    """Run documents, optionally of one run."""
    runs = spark.read.schema(METADATA_SCHEMA).json(root)
    runs = runs.select("run_id", *(c for c in runs.columns if c != "run_id"))
    return runs if run_index is None else runs.where(F.col("run_index") == run_index)
