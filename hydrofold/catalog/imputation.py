"""Queries over neighbours, masks, benchmarks, scores, autoencoder and result streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..fixtures import BASE, samples
from ..operators import benchmark, evaluation, examples, features, knn
from ..operators.filters import any_present
from ..operators.joins import cross_masks as cross
from ..operators.vae import VaeModel, VaeParams, vae_cross_validate as cross_validate, vae_impute as impute_with
from ..plans import imputation as study
from ..schema import BASE_FEATURES, PINNED_LABELS, feature_sets, q
from ..session import checkpointed, workspace
from ..sources import tables
from ..streaming import metrics as stream
from .features import SHORT, SPLIT_SQL, normal_sql
from .registry import register, rounded, r

KNN_COLUMNS = ["na", "mg", "ca", "fe", "ph"]
KEY = "sample_id"
_D = len(KNN_COLUMNS)


def _knn_sql() -> str:
    common = " + ".join(f"CASE WHEN a.{c} IS NOT NULL AND b.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in KNN_COLUMNS)
    squares = " + ".join(f"coalesce((a.{c} - b.{c}) * (a.{c} - b.{c}), 0e0)" for c in KNN_COLUMNS)
    requests = " UNION ALL ".join(f"SELECT *, {j} AS target FROM samples WHERE {c} IS NULL" for j, c in enumerate(KNN_COLUMNS))
    held = " WHEN ".join(f"{j} THEN b.{c}" for j, c in enumerate(KNN_COLUMNS))
    return f"""requests AS ({requests}),
pairs AS (SELECT a.sample_id, a.target, b.sample_id AS donor, CASE a.target WHEN {held} END AS v, {common} AS common, {squares} AS squares
  FROM requests a, samples b WHERE CASE a.target WHEN {held} END IS NOT NULL),
nearest AS (SELECT sample_id, target, min({{'distance': round(sqrt({_D}e0 / common * squares), 9), 'donor': donor, 'v': v}}, 5) AS best
  FROM pairs WHERE common > 0 GROUP BY 1, 2)"""


@register(f"""SELECT sample_id, target, generate_subscripts(best, 1)::INT AS rank, unnest(best).donor AS donor, unnest(best).distance AS distance
  FROM nearest""", _knn_sql())
def knn_join(spark, d):
    df = samples(spark, d)
    requests = knn.impute_requests(df, KEY, KNN_COLUMNS)
    joined = knn.knn_join(requests, df.select(q(KEY).alias("donor_id"), knn.vector(KNN_COLUMNS).alias("y")), _D)
    return knn.neighbour_rows(joined, [KEY, "target"])


@register("SELECT sample_id, " + ", ".join(
    f"""{r(f'''coalesce({c}, (SELECT list_avg(list_transform(best, lambda x: x.v)) FROM nearest n WHERE n.sample_id = samples.sample_id AND n.target = {j}),
    (SELECT avg({c}) FROM samples))''')} AS {c}""" for j, c in enumerate(KNN_COLUMNS)) + " FROM samples", _knn_sql())
def knn_impute(spark, d):
    filled = knn.knn_impute(samples(spark, d), KEY, KNN_COLUMNS).select(KEY, *KNN_COLUMNS)
    return rounded(filled, *KNN_COLUMNS)


@register("""SELECT level::INT AS level, mask, n_samples FROM (SELECT bit_count(m)::INT AS level, m AS mask, row_number() OVER (
  PARTITION BY bit_count(m) ORDER BY md5('42:' || CAST(m AS STRING))) AS i FROM (SELECT m::BIGINT AS m FROM range(1, 511) g(m))) x,
  (SELECT count(*) AS n_samples FROM samples)""")
def mask_table(spark, d):
    n = samples(spark, d).agg(F.count("*").alias("n_samples"))
    return examples.mask_table(spark, 9).crossJoin(F.broadcast(n))  # one row


MASKS = examples.mask_list(len(BASE))
_MASK_ROWS = ", ".join(f"({level}, {mask})" for level, mask in MASKS)


@register(f"SELECT sample_id, level, mask::BIGINT AS mask FROM samples, (VALUES {_MASK_ROWS}) v(level, mask)")
def cross_masks(spark, d):
    return cross(samples(spark, d).select(KEY), MASKS)


def visible_mean_imputer(columns):
    """A yardstick SQL can follow: a hidden cell is the mean of the row's visible standard scores."""
    def impute(requests):
        cells = [F.get("x", F.lit(j)) for j in range(len(columns))]
        seen = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in cells), F.lit(0))
        total = sum((F.coalesce(v, F.lit(0.0)) for v in cells), F.lit(0.0))
        return requests.withColumn("imputed", F.array_repeat(F.when(seen > 0, total / seen).otherwise(0.0), len(columns)))
    return impute


def results(spark, d, visible: bool = True, by_request: bool = False):
    make = (lambda train: visible_mean_imputer(BASE)) if visible else (lambda train: benchmark.mean_imputer(BASE))
    return benchmark.mask_benchmark(samples(spark, d), KEY, BASE, make, by_request=by_request)


def _results_sql(tag: str = "results", visible: bool = True, parts: int = 1) -> str:
    z = " + ".join(f"CASE WHEN mask & {1 << j} = 0 THEN z{j} ELSE 0e0 END" for j in range(len(BASE)))
    guess = f"(({z}) / ({len(BASE)} - bit_count(mask)))" if visible else "0e0"
    names = [f"CASE WHEN mask & {1 << j} <> 0 THEN '{c}' END" for j, c in enumerate(BASE)]
    cells = " UNION ALL ".join(
        f"SELECT sample_id, split, level, concat_ws(',', {', '.join(names)}) AS combination, '{c}' AS feature, {c} AS original, "
        f"{guess} * s{j} + m{j} AS imputed FROM hidden WHERE mask & {1 << j} <> 0" for j, c in enumerate(BASE))
    shared = f"""{SPLIT_SQL}, complete AS (SELECT * FROM split WHERE {' AND '.join(f'{c} IS NOT NULL' for c in BASE)}),
fit AS (SELECT {', '.join(f'avg({c}) AS m{j}, stddev_pop({c}) AS s{j}' for j, c in enumerate(BASE))} FROM complete WHERE split = 'Train'),
scored AS (SELECT * FROM complete WHERE split = 'Test' UNION ALL SELECT * EXCLUDE (i, n) FROM (SELECT *, row_number() OVER (
  ORDER BY md5('42:' || CAST(sample_id AS STRING))) AS i, count(*) OVER () AS n FROM complete WHERE split = 'Train') WHERE i <= greatest(1, n // {parts})),
hidden AS (SELECT scored.*, fit.*, level, mask, {', '.join(f'({c} - m{j}) / s{j} AS z{j}' for j, c in enumerate(BASE))}
  FROM scored, fit, (VALUES {_MASK_ROWS}) v(level, mask)), """
    return (shared if tag == "results" else "") + f"{tag} AS ({cells})"


RESULTS = _results_sql()


def _named(df):
    return df.withColumn("combination", F.array_join("combination", ","))


@register(f"SELECT sample_id, split, level, combination, feature, original, {r('imputed')} AS imputed FROM results", RESULTS)
def mask_benchmark(spark, d):
    return rounded(_named(results(spark, d)), "imputed")


def _mask_knn_sql() -> tuple[str, str]:
    """Brute force: every scored row against every training row under each mask."""
    visible = {mask: [j for j in range(len(BASE)) if not mask >> j & 1] for _, mask in MASKS}
    searches = " UNION ALL ".join(
        f"""SELECT a.sample_id, {mask} AS mask, min({{'distance': round(sqrt({float(len(BASE))!r}e0 / {len(seen)} * ({
            ' + '.join(f'(a.z{j} - b.z{j}) * (a.z{j} - b.z{j})' for j in seen)})), 9), 'donor': b.sample_id}}, 5) AS best
        FROM asked a, train b GROUP BY 1""" for mask, seen in visible.items())
    ctes = RESULTS + f""", scaled AS (SELECT complete.*, fit.*, {', '.join(f'({c} - m{j}) / s{j} AS z{j}' for j, c in enumerate(BASE))} FROM complete, fit),
train AS (SELECT * FROM scaled WHERE split = 'Train'), asked AS (SELECT * FROM scaled WHERE sample_id IN (SELECT sample_id FROM scored)),
found AS ({searches}),
guess AS (SELECT f.sample_id, f.mask, {', '.join(f'avg(t.z{j}) AS g{j}' for j in range(len(BASE)))}
  FROM (SELECT sample_id, mask, unnest(best).donor AS donor FROM found) f JOIN train t ON t.sample_id = f.donor GROUP BY 1, 2)"""
    names = ", ".join(f"CASE WHEN mask & {1 << j} <> 0 THEN '{c}' END" for j, c in enumerate(BASE))
    body = " UNION ALL ".join(
        f"""SELECT sample_id, split, bit_count(mask)::INT AS level, concat_ws(',', {names}) AS combination, '{c}' AS feature, {c} AS original,
        {r(f'g{j} * s{j} + m{j}')} AS imputed FROM asked JOIN guess USING (sample_id) WHERE mask & {1 << j} <> 0""" for j, c in enumerate(BASE))
    return body, ctes


@register(*_mask_knn_sql())
def mask_benchmark_knn(spark, d):
    rows = benchmark.mask_benchmark(samples(spark, d), KEY, BASE, lambda train: benchmark.knn_imputer(train, KEY, BASE))
    return rounded(_named(rows), "imputed")


_METRICS = """metrics AS (SELECT {keys}, count(*) AS n, sqrt(avg((imputed - original) * (imputed - original))) AS rmse,
  CASE WHEN var_pop(original) = 0 THEN CASE WHEN avg((imputed - original) * (imputed - original)) = 0 THEN 1e0 ELSE 0e0 END
  ELSE 1 - avg((imputed - original) * (imputed - original)) / var_pop(original) END AS r2 FROM {table} GROUP BY {keys})"""
_BY_FEATURE = _METRICS.format(keys="level, combination, feature", table="results")
_BY_MASK = _METRICS.format(keys="level, combination", table="results")


@register(f"SELECT level, combination, feature, n, {r('rmse')} AS rmse, {r('r2')} AS r2 FROM metrics", RESULTS + ", " + _BY_FEATURE)
def imputation_metrics(spark, d):
    return rounded(evaluation.imputation_metrics(_named(results(spark, d)), ["level", "combination", "feature"]), "rmse", "r2")


@register(f"SELECT split AS run_id, {r('avg(rmse)')} AS avg_rmse, {r('avg(r2)')} AS avg_r2, count(*) AS features FROM metrics WHERE level = 1 GROUP BY 1",
          RESULTS + ", " + _METRICS.format(keys="split, level, combination, feature", table="results"))
def run_summary(spark, d):
    rows = _named(results(spark, d)).withColumnRenamed("split", "run_id")
    return rounded(evaluation.run_summary(evaluation.imputation_metrics(rows, list(evaluation.METRIC_KEYS))), "avg_rmse", "avg_r2")


def _mask_metrics(spark, d):
    return evaluation.imputation_metrics(_named(results(spark, d)), ["level", "combination"], min_count=2)


_LEVELS = f"SELECT level, {r('avg(rmse)')} AS rmse, {r('avg(r2)')} AS r2, count(*) AS combinations, max(n) AS samples FROM metrics WHERE n >= 2 GROUP BY 1"


@register(_LEVELS, RESULTS + ", " + _BY_MASK)
def level_summary(spark, d):
    return rounded(evaluation.level_summary(_mask_metrics(spark, d)), "rmse", "r2")


@register(f"SELECT level, combination, {r('rmse')} AS rmse, combinations, samples FROM metrics JOIN (SELECT level, count(*) AS combinations, max(n) AS samples "
          "FROM metrics GROUP BY 1) USING (level)", RESULTS + ", " + _BY_MASK)
def attach_level_stats(spark, d):
    scored = checkpointed(_mask_metrics(spark, d), "mask-scores")  # dear to compute and few
    stats = evaluation.level_summary(scored).select("level", "combinations", "samples")
    return rounded(evaluation.attach_level_stats(scored.select("level", "combination", "rmse"), stats), "rmse")


@register(f"""SELECT level, n, {r('q1')} AS q1, {r('median')} AS median, {r('q3')} AS q3, {r('min(CASE WHEN inside THEN rmse END)')} AS whisker_low,
  {r('max(CASE WHEN inside THEN rmse END)')} AS whisker_high, count(*) FILTER (NOT inside) AS outliers FROM (
  SELECT *, rmse BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 AS inside FROM (SELECT level, rmse FROM metrics) JOIN (
    SELECT level, count(*) AS n, quantile_cont(rmse, 0.25) AS q1, quantile_cont(rmse, 0.5) AS median, quantile_cont(rmse, 0.75) AS q3 FROM metrics GROUP BY 1)
  USING (level)) GROUP BY level, n, q1, median, q3""", RESULTS + ", " + _BY_MASK)
def boxplot_stats(spark, d):
    box = evaluation.boxplot_stats(_mask_metrics(spark, d), ["level"], "rmse")
    return rounded(box, "q1", "median", "q3", "whisker_low", "whisker_high")


@register(f"SELECT level, combination, n, {r('rmse')} AS rmse, {r('r2')} AS r2, 'visible' AS model FROM metrics UNION ALL "
          f"SELECT level, combination, n, {r('rmse')}, {r('r2')}, 'mean' FROM metrics2",
          RESULTS + ", " + _results_sql("results2", False) + ", " + _BY_MASK + ", " + _BY_MASK.replace("metrics AS", "metrics2 AS").replace("FROM results", "FROM results2"))
def union_models(spark, d):
    models = {name: evaluation.imputation_metrics(_named(results(spark, d, name == "visible")), ["level", "combination"]) for name in ("visible", "mean")}
    return rounded(evaluation.union_models(models), "rmse", "r2")


@register(f"""SELECT level, {r('avg(m2.rmse)')} AS mean_rmse, {r('avg(m2.r2)')} AS mean_r2, {r('avg(metrics.rmse)')} AS visible_rmse,
  {r('avg(metrics.r2)')} AS visible_r2 FROM metrics JOIN metrics2 m2 USING (level, combination) GROUP BY 1""",
          RESULTS + ", " + _results_sql("results2", False) + ", " + _BY_MASK + ", " + _BY_MASK.replace("metrics AS", "metrics2 AS").replace("FROM results", "FROM results2"))
def compare_imputers(spark, d):
    table = evaluation.compare_imputers({"visible": results(spark, d, by_request=True), "mean": results(spark, d, False, by_request=True)})
    return rounded(table, *[c for c in table.columns if c != "level"])


@register(f"""SELECT sample_id, level, combination, feature, {r('least(greatest(original, low), high)')} AS original, {r('least(greatest(imputed, low), high)')} AS imputed
  FROM results JOIN (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, quantile_cont({c}, 0.02) AS low, quantile_cont({c}, 0.98) AS high FROM complete WHERE split = 'Train'" for c in BASE)
    + ") USING (feature)", RESULTS)
def clip_for_metrics(spark, d):
    rows, _ = benchmark.prepared(samples(spark, d), KEY, BASE)
    bounds = features.quantile_bounds(rows.where("split = 'Train'"), BASE)
    table = spark.createDataFrame([(c, *b) for c, b in bounds.items()], "feature string, low double, high double")
    clipped = features.clip_for_metrics(_named(results(spark, d)), table)
    return rounded(clipped.select(KEY, "level", "combination", "feature", "original", "imputed"), "original", "imputed")


@register(f"""SELECT feature, series, point::INT AS point, {r('x')} AS x, n, {r('sum(exp(-0.5e0 * pow((x - value) / h, 2))) / (n * h * sqrt(2 * pi()))')} AS density FROM (
    SELECT feature, series, n, h, point, lo - 3 * h + (hi - lo + 6 * h) / 99 * point AS x FROM (
      SELECT feature, series, count(*) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) * pow(count(*)::DOUBLE, -0.2e0) AS h FROM long GROUP BY 1, 2),
      range(100) g(point)) JOIN long USING (feature, series) GROUP BY feature, series, point, x, n, h""",
          RESULTS + """, long AS (SELECT feature, 'original' AS series, original AS value FROM results
  UNION ALL SELECT feature, 'imputed', imputed FROM results)""")
def imputation_density(spark, d):
    rows = results(spark, d)
    return rounded(evaluation.imputation_density(rows, ["feature"], points=100), "x", "density")


def _csv_rows(df):
    return _named(df).select(F.col("feature").alias("Feature"), F.col("original").alias("Original"), F.col("imputed").alias("Imputed"),
                             F.col("split").alias("Split"), F.col("level").alias("Masking_Level"), F.col("combination").alias("Masked_Combination"))


@register("SELECT feature AS \"Feature\", round(original, 4) AS \"Original\", split AS \"Split\", level AS \"Masking_Level\", "
          "combination AS \"Masked_Combination\", 'visible' AS model, 'a' AS run_id, "
          f"{r('imputed', 4)} AS \"Imputed\" FROM results", RESULTS)
def write_results(spark, d):
    root = workspace(spark, "results")
    rows = _csv_rows(results(spark, d)).withColumns({"model": F.lit("visible"), "run_id": F.lit("a")})
    tables.write_results(rows.where("Masking_Level <= 2"), root)
    tables.write_results(rows, root)  # levels written before are replaced
    return rounded(spark.read.parquet(root), "Imputed", digits=4)


_STREAM = _METRICS.format(keys="level, combination, feature", table="(SELECT level, combination, feature, round(original, 4) AS original, round(imputed, 4) AS imputed FROM results)")


def _streamed(spark, d):
    """Result files written in three waves, each followed by a run of the stream; the later ones replace levels 1 and 2."""
    root = workspace(spark, "stream")
    rows = _csv_rows(results(spark, d))  # made anew for each wave: hiding cells is cheaper than keeping them
    spark.createDataFrame([], tables.RESULT_SCHEMA).write.csv(f"{root}/in")
    for wave in (F.col("Masking_Level").isin(1, 2) & (F.col("Split") == "Test"), F.col("Masking_Level") != 2, F.col("Masking_Level") == 2):
        tables.write_result_csv(rows.where(wave), f"{root}/in", "000_Base")
        stream.stream_imputation_metrics(spark, f"{root}/in", f"{root}/out", f"{root}/state")
    return root


@register(f"SELECT '000_Base' AS run_id, level, combination, feature, n, {r('rmse', 5)} AS rmse, {r('r2', 5)} AS r2 FROM metrics", RESULTS + ", " + _STREAM)
def stream_imputation_metrics(spark, d):
    return rounded(stream.current_metrics(spark, f"{_streamed(spark, d)}/out"), "rmse", "r2", digits=5)


@register(f"SELECT '000_Base' AS run_id, {r('avg(rmse)', 5)} AS avg_rmse, {r('avg(r2)', 5)} AS avg_r2, count(*) AS features FROM metrics WHERE level = 1",
          RESULTS + ", " + _STREAM)
def run_until_complete(spark, d):
    root = _streamed(spark, d)
    early = stream.run_until_complete(spark, f"{root}/in", f"{root}/out", f"{root}/state", f"{root}/DONE")
    assert early is None
    spark.range(1).write.parquet(f"{root}/DONE")
    summary = stream.run_until_complete(spark, f"{root}/in", f"{root}/out", f"{root}/state", f"{root}/DONE")
    return rounded(summary, "avg_rmse", "avg_r2", digits=5)


@register()
def vae_fit(spark, d):
    model = study.train_vae(samples(spark, d), KEY, BASE, folds=0)
    losses = [(i + 1, float(v), model.n_samples) for i, v in enumerate(model.loss_history)]
    return spark.createDataFrame(losses, "epoch int, loss double, n_samples long")


@register()
def vae_cross_validate(spark, d):
    rows, scaling = benchmark.prepared(samples(spark, d), KEY, BASE, clip=0.02)
    return cross_validate(scaling.transform(rows.where("split = 'Train'")), KEY, BASE)


@register()
def vae_impute(spark, d):
    df = samples(spark, d)
    model = study.train_vae(df, KEY, BASE, folds=0)
    return impute_with(any_present(df, BASE).select(KEY, *BASE), KEY, model)


# A network of two inputs, two hidden cells and one latent cell with weights written out.
_SMALL = [0.5, -0.25, 0.75, 0.5, 0.125, -0.5, 0.5, -0.75, 0.25, 0.1, 0.2, 0.3, 0.5, -1.5, 0.25, 0.5, 1.5, 0.5, -0.25, 0.75, 0.1, -0.2]


def _small_sql(noise: str = "0e0") -> str:
    """The network written out, with ``noise`` as the draw of its latent cell."""
    w = [f"({v!r}e0)" for v in _SMALL]
    leak = lambda a: f"(CASE WHEN {a} > 0 THEN {a} ELSE 0.2e0 * ({a}) END)"
    x = ["coalesce(ph, 0e0)", "coalesce(fe, 0e0)"]
    h = [leak(f"({x[0]} * {w[j]} + {x[1]} * {w[2 + j]} + {w[4 + j]})") for j in range(2)]
    z = f"({h[0]} * {w[6]} + {h[1]} * {w[7]} + {w[8]} + {noise} * exp(0.5e0 * ({h[0]} * {w[9]} + {h[1]} * {w[10]} + {w[11]})))"
    g = [leak(f"({z} * {w[12 + j]} + {w[14 + j]})") for j in range(2)]
    out = [f"({g[0]} * {w[16 + j]} + {g[1]} * {w[18 + j]} + {w[20 + j]})" for j in range(2)]
    return f"SELECT sample_id, {r(f'coalesce(ph, {out[0]})')} AS ph, {r(f'coalesce(fe, {out[1]})')} AS fe FROM samples"


_SMALL_MODEL = VaeModel(("ph", "fe"), VaeParams(latent_dim=1, hidden_dim=2, enc_layers=1, dec_layers=1), np.array(_SMALL))


@register(_small_sql())
def vae_forward(spark, d):
    """Inference of a network with fixed weights."""
    return rounded(impute_with(samples(spark, d).select(KEY, "ph", "fe"), KEY, _SMALL_MODEL), "ph", "fe")


@register(_small_sql("noise").replace("FROM samples", "FROM drawn"), f"""drawn AS (SELECT *, {normal_sql('g', 't')} AS noise FROM (
  SELECT *, p - 0.5 AS g, sqrt(-ln(least(p, 1 - p))) AS t FROM (
    SELECT *, (CAST(concat('0x', substr(md5(concat('42:', sample_id, ':0')), 1, 13)) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS p FROM samples)))""")
def vae_forward_sampled(spark, d):
    """The same with its latent cell drawn."""
    return rounded(impute_with(samples(spark, d).select(KEY, "ph", "fe"), KEY, _SMALL_MODEL, sample_latent=True), "ph", "fe")


@register()
def vae_benchmark(spark, d):
    df = samples(spark, d)
    return _named(study.vae_benchmark(df, KEY, study.train_vae(df, KEY, BASE, folds=0)))


def _sets(spark, d, max_extra: int) -> dict[str, list[str]]:
    """The feature sets that availability ranks, by their columns in the sample table."""
    return study.available_sets(samples(spark, d), list(BASE_FEATURES), resolve=SHORT.get, max_extra=max_extra)


def _sets_sql(max_extra: int) -> list[tuple[str, list[str]]]:
    """All sets with a column for every feature, by label; equal sets of columns once, as pinned or listed first."""
    listed = sorted(enumerate(feature_sets(max_extra=max_extra)), key=lambda s: (PINNED_LABELS.index(s[1][0]) if s[1][0] in PINNED_LABELS else len(PINNED_LABELS), s[0]))
    found: dict[str, list[str]] = {}
    for _, (label, extra) in listed:
        columns = [SHORT.get(f) for f in [*BASE_FEATURES, *extra]]
        if all(columns) and sorted(columns) not in map(sorted, found.values()):
            found[label] = columns
    return list(found.items())


def _statistics_sql() -> str:
    """One SELECT a set: its complete training rows, clipped at their quantiles, and what is left of them."""
    selects = []
    for label, columns in _sets_sql(2):
        complete = " AND ".join(f"{c} IS NOT NULL" for c in columns)
        for c in columns:
            selects.append(
                f"SELECT '{label}' AS label, '{c}' AS feature, count(*) AS n, {r('min(l)')} AS low, {r('min(h)')} AS high, "
                f"{r('avg(least(greatest(v, l), h))')} AS mean, {r('stddev_pop(least(greatest(v, l), h))')} AS scale FROM (SELECT {c} AS v, "
                f"quantile_cont({c}, 0.02) OVER () AS l, quantile_cont({c}, 0.98) OVER () AS h FROM split WHERE split = 'Train' AND {complete})")
    return " UNION ALL ".join(f"({s} HAVING count(*) > 0)" for s in selects)


@register(_statistics_sql(), SPLIT_SQL.replace("split AS (", "split AS MATERIALIZED ("))
def set_statistics(spark, d):
    """What every available set's model is fitted on: rows, clipping bounds and scaling."""
    found = study.set_statistics(samples(spark, d), KEY, _sets(spark, d, 2))
    rows = [(label, c, s.n, *s.bounds[c], s.scaling.mean[i], s.scaling.scale[i]) for label, s in found.items() for i, c in enumerate(s.scaling.columns)]
    table = spark.createDataFrame(rows, "label string, feature string, n long, low double, high double, mean double, scale double")
    return rounded(table, "low", "high", "mean", "scale")


@register()
def imputation_study(spark, d):
    root = workspace(spark, "study")
    tables.write_run_metadata(study.imputation_study(samples(spark, d), KEY, _sets(spark, d, 2)), root)
    return tables.read_run_metadata(spark, root).select("run_id", "n_samples", "final_loss", "cv_score", "cv_masked_score")


@register()
def imputation_report(spark, d):
    return study.imputation_report(samples(spark, d), KEY, _sets(spark, d, 1)).metrics


@register()
def imputer_comparison(spark, d):
    return study.imputer_comparison(samples(spark, d), KEY, BASE)
