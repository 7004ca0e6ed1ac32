"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all), BENCH_QUERIES (comma list), BENCH_RUNS, BENCH_WORK.
Each query is run to its last row through the no-op sink. The cleaned sample table is a query of its own;
the others read it as written, as they would after acquisition.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from hydrofold import fixtures
from hydrofold.catalog import QUERIES
from hydrofold.session import session

HEADLINE = (
    "acquire_source", "expand_lithology", "ionic_balance_error", "filter_ibe_temperature", "column_profile", "histogram",
    "row_completeness_histogram", "summary_by_source", "nearest_to_target_per_source", "completeness_beam", "featureset_availability",
    "preprocess", "gaussianize", "pca2", "som_assign", "som_fit", "cluster_profile", "mann_whitney", "kde", "rf_importance_global",
    "knn_impute", "mask_benchmark", "mask_benchmark_knn", "imputation_metrics", "boxplot_stats", "vae_cross_validate", "vae_impute",
    "stream_imputation_metrics",
)


def timed(run) -> float:
    started = time.perf_counter()
    run()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 1))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = session("bench", f"local[{cpus}]", **{
        "spark.checkpoint.dir": os.environ.get("BENCH_WORK") or tempfile.mkdtemp(prefix="bench-"),
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1 << 20).selectExpr("id % 8 AS k").groupBy("k").count().collect()  # start the executors' threads
    seconds = {"clean_samples": timed(lambda: fixtures.samples(spark, folder).write.format("noop").mode("overwrite").save())}
    for name in names:
        run = lambda: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = statistics.median(timed(run) for _ in range(runs))
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": {k: round(v, 3) for k, v in seconds.items()}, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
