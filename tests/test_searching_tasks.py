"""Requests of a benchmark that are searched in tasks that hold all donors."""

import numpy as np
import pandas as pd

from hydrofold.operators import benchmark, knn

COLUMNS = ["a", "b", "c"]


def test_search_in_tasks_agrees_with_the_join(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(400, 3)), 1)
    x[::4] = x[0]  # equal rows
    df = spark.createDataFrame(pd.DataFrame(x, columns=COLUMNS).assign(id=np.arange(400)))
    make = lambda train: benchmark.knn_imputer(train, "id", COLUMNS, 5)
    joins, keep = [], knn.knn_join
    monkeypatch.setattr(benchmark, "knn_join", lambda *a: (joins.append(a), keep(*a))[1])
    found = {}
    for donors in (1 << 19, 10):
        monkeypatch.setattr(benchmark, "WHOLE_DONORS", donors)
        found[donors] = benchmark.mask_benchmark(df, "id", COLUMNS, make).orderBy("id", "level", "combination", "feature").toPandas()
    assert len(joins) == 1  # donors that fit a task need no join
    pd.testing.assert_frame_equal(found[1 << 19], found[10])
    assert len(found[10]) == 400 * 9


def test_a_hidden_cell_is_no_request_of_its_own_where_donors_hold_every_feature(spark, monkeypatch):
    df = spark.createDataFrame(pd.DataFrame(np.random.default_rng(7).random((60, 3)), columns=COLUMNS).assign(id=np.arange(60)))
    asked, keep = [], knn.knn_join
    monkeypatch.setattr(benchmark, "WHOLE_DONORS", 10)
    monkeypatch.setattr(benchmark, "knn_join", lambda requests, *a: (asked.append(requests.count()), keep(requests, *a))[1])
    benchmark.mask_benchmark(df, "id", COLUMNS, lambda train: benchmark.knn_imputer(train, "id", COLUMNS, 5)).count()
    assert asked == [60 * 6]  # a request a mask, where there are nine hidden cells
