"""A search of neighbours leaves behind what its result is read from, not its steps."""

import os
import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hydrofold import session
from hydrofold.operators import knn


def stored(folder):
    return {re.sub(r"-[0-9a-f]{12}$", "", name) for name in os.listdir(folder)}


def test_steps_of_a_search_are_dropped_before_its_result_is_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "workspace", lambda spark, purpose: f"{tmp_path}/{purpose}-{uuid.uuid4().hex[:12]}")
    x = np.random.default_rng(0).random((300, 2))
    x[::3, 0] = np.nan
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=np.arange(300))).select("id", F.nanvl("a", F.lit(None)).alias("a"), "b")
    filled = knn.knn_impute(df, "id", ["a", "b"], cell_rows=50)
    assert "neighbours" in stored(tmp_path)
    assert not stored(tmp_path) & {"donors", "donor-leaves", "donor-bins", "requests", "first-bins", "first-visits", "other-bins", "other-visits"}
    assert filled.where("a IS NULL").count() == 0 and filled.count() == 300


def test_shuffles_of_a_written_table_are_dropped(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    given = spark.conf.get(setting)
    held = manager.shuffleStatuses().size()
    kept = session.checkpointed(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "few")
    assert manager.shuffleStatuses().size() <= held
    assert kept.count() == 10 and spark.conf.get(setting) == given
