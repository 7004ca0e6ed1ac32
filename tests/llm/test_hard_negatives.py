"""Exact products by residues, and hard negatives against a plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrofold.llm.hard_negatives import mine
from hydrofold.llm.residues import Residues


@pytest.mark.parametrize("dimension,most", [(1, 1), (3, 0), (64, 256), (64, 40_000_000), (700, 5000)])
def test_products_are_exact(dimension, most):
    rng = np.random.default_rng(dimension)
    a, b = (rng.integers(-most, most + 1, (n, dimension)) for n in (7, 11))
    a[0], b[0], b[1] = most, most, -most
    system = Residues(dimension, dimension * most ** 2)
    assert len(system.primes) >= (1 if most < 2 else 2)
    want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
    assert system.products(system.split(a), system.split(b)).tolist() == want
    with pytest.raises(ValueError):
        Residues(1, 1 << 61)


def brute(rows, anchors, positives, negatives):
    found = []
    for a, label, u in (r for r in rows if anchors(r[0])):
        scored = sorted(((sum(x * y for x, y in zip(u, v)), -i, other) for i, other, v in rows), reverse=True)
        for score, i, _ in [s for s in scored if s[2] == label and -s[1] != a][:positives]:
            below = [s for s in scored if s[2] != label and 80 * score <= 100 * s[0] <= 100 * score][:negatives]
            found += [(a, -i, rank + 1, -n, score, s) for rank, (s, n, _) in enumerate(below)]
    return sorted(found)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 6))
    rows = []
    for i in range(400):
        v = np.round(centre[i % 4] + rng.normal(scale=0.7, size=6), 2)
        rows.append((i, [float(x) for x in v], i % 3))
    for i in range(0, 120):  # a third share one vector, which makes ties
        rows[3 * i] = (3 * i, rows[0][1], rows[3 * i][2])
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int, is_anchor string, part string, rank string"


@pytest.mark.parametrize("block", [20_000, 37])
def test_rows_equal_plain_search(spark, vectors, block):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in vectors], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in mine(df, F.col("vec_id") % 20 == 0, scale=16, block_rows=block, negatives=4).collect())
    rows = [(i, label, [int(np.floor(16 * x)) for x in v]) for i, v, label in vectors]
    want = brute(rows, lambda i: i % 20 == 0, 5, 4)
    assert got == want and len(got) > 100


def test_rows_that_take_no_part(spark, vectors):
    odd = [(None, [1.0] * 6, 1), (500, None, 1), (501, [1.0] * 6, None), (502, [1.0] * 5 + [None], 1), (503, [float("nan")] + [1.0] * 5, 2),
           (504, [float("inf")] + [9.0] * 5, 2), (505, [9.0] * 4, 2), (506, [], 2)]
    df, more = (spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA) for rows in (vectors, vectors + odd))
    run = lambda x: sorted(tuple(r) for r in mine(x, F.col("vec_id") % 50 == 0).collect())
    assert run(df) == run(more)
    assert mine(df.limit(0), F.lit(True)).count() == 0 and mine(df.where("vec_id is null"), F.lit(True)).count() == 0
    assert mine(df.where("label = 1"), F.lit(True)).count() == 0  # no row of another label
    assert mine(df, F.lit(None).cast("boolean")).count() == 0
    with pytest.raises(ValueError):
        mine(spark.createDataFrame([(1, [1e300], 1, "x", "y", "z")], SCHEMA), F.lit(True))


def test_repeated_rows_count_each(spark, vectors):
    few = [(*r, "x", "y", "z") for r in vectors[:60]]
    once, twice = (mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 20, positives=2, negatives=60, low=0) for rows in (few, few + few))
    assert twice.count() > once.count()
    assert {r["negative_id"] for r in twice.collect()} >= {r["negative_id"] for r in once.limit(1).collect()}
