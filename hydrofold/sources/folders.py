"""Snapshot folders as a small catalog, through the Hadoop file system the session already uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def list_folders(spark: SparkSession, root: str) -> list[tuple[str, int, int]]:
    """(name, modification time, bytes) of the folders under ``root``."""
    fs, path = _fs(spark, root)
    found = []
    for status in fs.listStatus(path):
        if status.isDirectory():
            child = status.getPath()
            found.append((child.getName(), status.getModificationTime(), fs.getContentSummary(child).getLength()))
    return found


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _fs(spark, path)
    return fs.exists(hadoop_path)


def latest_snapshot(spark: SparkSession, root: str, by: str = "name", min_bytes: int = 0) -> str:
    """Path of the newest snapshot folder, by name or by modification time, with at least ``min_bytes`` of data."""
    folders = [f for f in list_folders(spark, root) if f[2] >= min_bytes]
    if not folders:
        raise FileNotFoundError(f"no snapshot of at least {min_bytes} bytes under {root}")
    newest = max(folders, key=(lambda f: f[0]) if by == "name" else (lambda f: (f[1], f[0])))
    return f"{root.rstrip('/')}/{newest[0]}"
