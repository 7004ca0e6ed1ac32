"""Imputation study: feature sets to trained models, their documents, benchmarks and comparisons."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import benchmark, evaluation
from ..operators.completeness import feature_set_plan, featureset_availability
from ..operators.features import Standard, clipped, quantile_clip, select_features, split_label
from ..operators.filters import complete_cases
from ..operators.ranking import bracketed_quantiles
from ..operators.vae import Training, VaeModel, VaeParams, fitted, vae_fit_sets, vae_imputer
from ..schema import OPTIONAL_FEATURES, q
from ..session import checkpointed
from ..sources.tables import METADATA_SCHEMA

MIN_ROWS = 50


def available_sets(df: DataFrame, base: list[str], pool=OPTIONAL_FEATURES, resolve=None, max_extra: int = 3, manual=None,
                   min_rows: int = MIN_ROWS) -> dict[str, list[str]]:
    """Feature sets by label, in the order of their availability: those with enough complete rows whose features all have a column.

    Of sets that stand for the same columns the first stays.
    """
    resolve = resolve or (lambda f: f if f in df.columns else None)
    listed = featureset_availability(df, base, pool, resolve, max_extra, manual).where(F.col("n") >= min_rows).orderBy("rank").collect()  # a row for each set
    found: dict[str, list[str]] = {}
    for row in listed:
        columns = [resolve(f) for f in row["features"]]
        if all(columns) and sorted(columns) not in map(sorted, found.values()):
            found[row["label"]] = columns
    return found


@dataclass(frozen=True)
class SetStatistics:
    """What the training rows of a feature set say: how many there are, clipping bounds, and the scaling of the clipped values."""

    n: int
    bounds: dict[str, tuple[float, float]]
    scaling: Standard


def set_statistics(df: DataFrame, key: str, sets: dict[str, list[str]], clip: float | None = 0.02, test_fraction: float = 0.1,
                   seed: int = 42) -> dict[str, SetStatistics]:
    """Statistics of all sets over their complete training rows, which are written once; passes over them serve all sets.

    Sets without a complete training row are left out.
    """
    if not sets:
        return {}
    complete = lambda columns: reduce(Column.__and__, [q(c).isNotNull() for c in columns])
    member = F.array(*[F.when(complete(columns), F.struct(F.lit(label).alias("label"), F.array(*[q(c).cast("double") for c in columns]).alias("x")))
                       for label, columns in sets.items()])
    used = list(dict.fromkeys(c for columns in sets.values() for c in columns))
    rows = checkpointed(df.where(split_label(q(key), test_fraction, seed) == "Train").select([q(c) for c in used]), "set-rows")
    train = rows.select(F.explode(F.array_compact(member)).alias("m"))
    cells = train.select("m.label", F.posexplode("m.x").alias("place", "value"))
    names = {(label, place): c for label, columns in sets.items() for place, c in enumerate(columns)}
    if clip is None:
        clipped_cells, bounds = cells, {}
    else:
        quantiles = bracketed_quantiles(cells, ["label", "place"], "value", [clip, 1 - clip]).select(
            "label", "place", F.col("quantiles")[0].alias("low"), F.col("quantiles")[1].alias("high"))
        found = quantiles.collect()  # a row for each feature of each set
        bounds = {(r["label"], r["place"]): (r["low"], r["high"]) for r in found}
        known = df.sparkSession.createDataFrame(found, quantiles.schema)
        clipped_cells = cells.join(F.broadcast(known), ["label", "place"]).withColumn("value", clipped(F.col("value"), F.col("low"), F.col("high")))
    rows = clipped_cells.groupBy("label", "place").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("scale")).collect()
    fitted_rows = {(r["label"], r["place"]): r for r in rows}
    out = {}
    for label, columns in sets.items():
        mine = [fitted_rows.get((label, i)) for i in range(len(columns))]
        if all(mine):
            scaling = Standard(tuple(columns), tuple(m["mean"] for m in mine), tuple(m["scale"] or 1.0 for m in mine))
            out[label] = SetStatistics(mine[0]["n"], {names[label, i]: bounds[label, i] for i in range(len(columns)) if (label, i) in bounds}, scaling)
    return out


def train_sets(df: DataFrame, key: str, sets: dict[str, list[str]], params: dict[str, VaeParams], folds: int = 5, clip: float | None = 0.02,
               test_fraction: float = 0.1, min_rows: int = MIN_ROWS) -> dict[str, VaeModel]:
    """Models of all feature sets with enough complete rows, trained in the same rounds; the sets' seeds must agree."""
    seed = next(iter(params.values())).seed
    enough = {r["label"] for r in _complete_counts(df, sets) if r["n"] >= min_rows}
    statistics = set_statistics(df, key, {label: c for label, c in sets.items() if label in enough}, clip, test_fraction, seed)
    train = df.where(split_label(q(key), test_fraction, seed) == "Train")
    trainings = {}
    for label, found in statistics.items():
        columns = sets[label]
        rows = complete_cases(train, columns).select(q(key), *[q(c) for c in columns])
        rows = found.scaling.transform(quantile_clip(rows, found.bounds) if found.bounds else rows)
        trainings[label] = Training(rows, key, tuple(columns), params[label], folds)
    models = vae_fit_sets(list(trainings.values())) if trainings else []
    return {label: fitted(model, statistics[label].scaling, statistics[label].bounds) for label, model in zip(trainings, models)}


def _complete_counts(df: DataFrame, sets: dict[str, list[str]]) -> list:
    """(label, n): complete rows of every set, from one scan."""
    counts = df.agg(*[F.count(F.when(reduce(Column.__and__, [q(c).isNotNull() for c in columns]), 1)).alias(f"n{i}") for i, columns in enumerate(sets.values())]).first()
    return [{"label": label, "n": counts[i]} for i, label in enumerate(sets)]


def train_vae(df: DataFrame, key: str, columns: list[str], params: VaeParams = VaeParams(), folds: int = 5, clip: float | None = 0.02,
              test_fraction: float = 0.1, min_rows: int = MIN_ROWS) -> VaeModel | None:
    """Complete rows, split, clipped and scaled on the training part, cross-validated and trained; None with too few rows."""
    return train_sets(df, key, {"": list(columns)}, {"": params}, folds, clip, test_fraction, min_rows).get("")


def run_document(spark: SparkSession, run_index: int, label: str, wanted: Iterable[str], report: dict, model: VaeModel, clip: float | None) -> DataFrame:
    """The nested document of one trained model, weights included."""
    p, b = model.params, model.bounds
    row = (
        f"{run_index:03d}_{label}", run_index, label, list(wanted), list(model.columns), {k: v or "" for k, v in report.items()},
        model.n_samples, float(model.loss_history[-1]) if model.loss_history else None, p.latent_dim, p.enc_layers, p.dec_layers, p.hidden_dim,
        float(np.mean(model.fold_scores)) if model.fold_scores else None,
        float(np.mean(model.fold_masked_scores)) if model.fold_masked_scores else None,
        list(map(float, model.fold_scores)), list(map(float, model.fold_masked_scores)), (len(model.fold_scores), 0.1, True),
        p.epochs, p.batch_size, p.kld_weight, list(map(float, model.loss_history)),
        (bool(b), clip, [float(b[c][0]) for c in model.columns if c in b], [float(b[c][1]) for c in model.columns if c in b]),
        list(model.scaling.mean) if model.scaling else None, list(model.scaling.scale) if model.scaling else None,
        [float(w) for w in model.weights])
    return spark.createDataFrame([row], METADATA_SCHEMA)


def model_of(document) -> VaeModel:
    """A model back from its document row."""
    columns = tuple(document["features_mapped"])
    params = VaeParams(document["latent_dim"], document["hidden_dim"], document["enc_layers"], document["dec_layers"],
                       document["epochs_trained"], document["batch_size"], document["kld_weight"])
    clip = document["quantile_clipping"]
    bounds = dict(zip(columns, zip(clip["lower"], clip["upper"]))) if clip and clip["active"] else {}
    return VaeModel(columns, params, np.array(document["weights"]), Standard(columns, tuple(document["mean"]), tuple(document["scale"])),
                    tuple(document["training_loss_history"]), document["n_samples"], tuple(document["cv_fold_scores"]),
                    tuple(document["cv_masked_fold_scores"]), bounds)


def imputation_study(df: DataFrame, key: str, sets: dict[str, list[str]], params: VaeParams = VaeParams(), folds: int = 5,
                     clip: float | None = 0.02, max_models: int | None = None) -> DataFrame:
    """Run documents of all feature sets (or of the first ``max_models``), in the given order; sets with too few rows are skipped."""
    resolved = {label: select_features(df.columns, wanted) for label, wanted in sets.items()}
    enough = {r["label"] for r in _complete_counts(df, {label: c for label, (c, _) in resolved.items()}) if r["n"] >= MIN_ROWS}
    chosen = [label for label in sets if label in enough][:max_models]
    models = train_sets(df, key, {label: resolved[label][0] for label in chosen}, dict.fromkeys(chosen, params), folds, clip) if chosen else {}
    numbers = {label: i for i, label in enumerate(sets)}
    documents = [run_document(df.sparkSession, numbers[label], label, sets[label], resolved[label][1], model, clip) for label, model in models.items()]
    return reduce(DataFrame.unionByName, documents) if documents else df.sparkSession.createDataFrame([], METADATA_SCHEMA)


@dataclass(frozen=True)
class StudyReport:
    """Feature sets with their rows and model sizes, run documents, scores of every mask, and a summary per run."""

    plan: DataFrame
    documents: DataFrame
    metrics: DataFrame
    summary: DataFrame


def imputation_report(df: DataFrame, key: str, sets: dict[str, list[str]], params: VaeParams | None = None, folds: int = 5,
                      clip: float | None = 0.02, train_parts: int = 1) -> StudyReport:
    """From feature sets to scores: rows and sizes per set, one trained model each, its benchmark and the runs' summary.

    Without ``params`` each model takes the sizes of ``feature_set_plan`` from its features and complete rows.
    """
    spark = df.sparkSession
    resolved = {label: select_features(df.columns, wanted) for label, wanted in sets.items()}
    columns = {label: c for label, (c, _) in resolved.items()}
    listed = [(r["label"], columns[r["label"]], r["n"]) for r in _complete_counts(df, columns)]
    plan = feature_set_plan(spark.createDataFrame(listed, "label string, features array<string>, n long"))
    own = {r["label"]: params or VaeParams(latent_dim=r["latent_dim"], hidden_dim=r["hidden_dim"], enc_layers=r["layers"], dec_layers=r["layers"],
                                           batch_size=r["batch_size"]) for r in plan.collect()}  # one row per set
    models = train_sets(df, key, columns, own, folds, clip)
    if not models:
        raise ValueError("no feature set has enough complete rows to train on")
    documents, metrics = [], []
    for index, label in enumerate(sets):
        if label not in models:
            continue
        documents.append(run_document(spark, index, label, sets[label], resolved[label][1], models[label], clip))
        results = vae_benchmark(df, key, models[label], train_parts=train_parts).withColumns({
            "run_id": F.lit(f"{index:03d}_{label}"), "combination": F.array_join("combination", ",")})
        metrics.append(evaluation.imputation_metrics(results, list(evaluation.METRIC_KEYS)))
    scores = checkpointed(reduce(DataFrame.unionByName, metrics), "study-scores")
    return StudyReport(plan, reduce(DataFrame.unionByName, documents), scores, evaluation.run_summary(scores))


def vae_benchmark(df: DataFrame, key: str, model: VaeModel, include_incomplete: bool = False, cap: int | None = None, seed: int = 42,
                  sample_latent: bool = False, train_parts: int = 1) -> DataFrame:
    """Mask benchmark of a trained model, on its own scaling."""
    columns = list(model.columns)
    rows, _ = benchmark.prepared(df, key, columns, include_incomplete, seed=seed)
    requests = benchmark.benchmark_requests(rows, key, columns, model.scaling, benchmark.mask_list(len(columns), cap, seed), seed, train_parts)
    return benchmark.result_rows(vae_imputer(model, "request_id" if sample_latent else None)(requests), key, columns, model.scaling)


def imputer_comparison(df: DataFrame, key: str, columns: list[str], params: VaeParams = VaeParams(), k: int = 5,
                       include_incomplete: bool = False, train_parts: int = 1) -> DataFrame:
    """Mean scores per masking level of the autoencoder and nearest neighbours on the same hidden cells."""
    model = train_vae(df, key, columns, params, folds=0)
    if model is None:
        raise ValueError("too few complete rows to train on")
    return evaluation.compare_imputers({
        "VAE": vae_benchmark(df, key, model, include_incomplete, train_parts=train_parts),
        "kNN": benchmark.mask_benchmark(df, key, columns, lambda train: benchmark.knn_imputer(train, key, columns, k), include_incomplete,
                                        train_parts=train_parts)})
