"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "hydrofold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; anything in ``conf`` wins."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workspace(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for tables a job writes and reads back.

    It lies under ``spark.checkpoint.dir``, or where that is not set under the warehouse: both are folders that every
    executor reaches. The folder is dropped when the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # the session is gone; the folder stays for the owner of the shared root
        pass


def checkpointed(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there and survives lost executors.

    What was shuffled for the table is dropped as soon as it is written, not when the driver next collects garbage.
    """
    spark, setting = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = workspace(spark, purpose), spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._written_to = path
    return kept


def released(*tables: DataFrame) -> None:
    """Drop tables that ``checkpointed`` wrote, once what was made of them is written itself."""
    for table in tables:
        _drop(table.sparkSession, table._written_to)


def balanced(df: DataFrame, key: str, rows_per_task: int) -> DataFrame:
    """Rows dealt out by key ahead of a stage that does much work per row.

    Adaptive execution sizes tasks by bytes and would put a small table with much work into a single one.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_per_task))
    return df.repartition(tasks, key)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that is read in fewer tasks than there are cores are spread over them; others stay in place."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
