"""Queries over completeness, feature preparation and scaling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..fixtures import BASE, NUMERIC, samples
from ..functions import normal
from ..operators import completeness, features
from ..operators.profile import unpivot
from ..plans.preprocess import preprocess
from ..schema import BASE_FEATURES, PINNED_LABELS, feature_sets, q
from .registry import register, rounded, r

POOL = ["na", "mg", "fe", "ph", "temperature", "depth_m", "period", "latitude", "longitude", "rock_type"]
SHORT = {"Na_in_mmol/L": "na", "Mg_in_mmol/L": "mg", "Ca_in_mmol/L": "ca", "Cl_in_mmol/L": "cl", "SO4_in_mmol/L": "so4",
         "HCO3_in_mmol/L": "hco3", "temperature_in_c": "temperature", "pH": "ph", "Fe_in_mmol/L": "fe", "depth_bgl_in_m": "depth_m"}


def _mask_sql(columns) -> str:
    return " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {1 << i} ELSE 0 END" for i, c in enumerate(columns))


@register(f"SELECT ({_mask_sql(POOL)})::BIGINT AS mask, count(*) AS n FROM samples GROUP BY 1")
def pattern_counts(spark, d):
    return completeness.pattern_counts(samples(spark, d), POOL)


def _beam_sql(columns, sizes: int, beam: int, top: int) -> tuple[str, str]:
    names = "[" + ", ".join(f"'{c}'" for c in columns) + "]"
    ctes = [f"pat AS (SELECT ({_mask_sql(columns)})::BIGINT AS mask, count(*) AS n FROM samples GROUP BY 1)",
            "t0 AS (SELECT 0::BIGINT AS mask, -1 AS last, '' AS features, 1 AS place, 0::BIGINT AS n)"]
    for size in range(1, sizes + 1):
        ctes.append(f"""c{size} AS (SELECT (p.mask | (1 << i))::BIGINT AS mask, i AS last, p.place AS parent,
  CASE WHEN p.features = '' THEN {names}[i + 1] ELSE p.features || ', ' || {names}[i + 1] END AS features
  FROM t{size - 1} p, (SELECT i::INT AS i FROM range({len(columns)}) g(i)) WHERE i > p.last AND p.place <= {beam})""")
        ctes.append(f"""t{size} AS (SELECT c.mask, c.last, c.features, sum(pat.n)::BIGINT AS n,
  row_number() OVER (ORDER BY sum(pat.n) DESC, c.parent, c.last) AS place
  FROM c{size} c JOIN pat ON (pat.mask & c.mask) = c.mask GROUP BY c.mask, c.last, c.features, c.parent)""")
    body = " UNION ALL ".join(
        f"""SELECT {size}::INT AS size, place::INT AS place, features, n, n / (SELECT sum(n) FROM pat) * 100e0 AS percent,
        ((SELECT sum(n) FROM pat) - n)::BIGINT AS missing FROM t{size} WHERE place <= {top}""" for size in range(1, sizes + 1))
    return body, ", ".join(ctes)


@register(*_beam_sql(POOL, len(POOL), 1_000_000, 10))
def completeness_beam(spark, d):
    return completeness.completeness_beam(samples(spark, d), POOL)


@register(*_beam_sql(POOL, len(POOL), 3, 3))
def beam_topk(spark, d):
    return completeness.completeness_beam(samples(spark, d), POOL, beam=3, top=3)


def _availability_sql() -> str:
    columns = sorted(SHORT.values())
    bit = {c: 1 << i for i, c in enumerate(columns)}
    rows = []
    for place, (label, extra) in enumerate(feature_sets()):
        listed = [*BASE_FEATURES, *extra]
        mask = 0
        for f in listed:
            mask |= bit.get(SHORT.get(f, ""), 0)
        pin = PINNED_LABELS.index(label) if label in PINNED_LABELS else len(PINNED_LABELS)
        rows.append(f"({place}, '{label}', [{', '.join(repr(f) for f in listed)}], {mask}::BIGINT, {pin})")
    return (f"pat AS (SELECT ({_mask_sql(columns)})::BIGINT AS mask, count(*) AS n FROM samples GROUP BY 1), "
            f"listed(pos, label, features, mask, pin) AS (VALUES {', '.join(rows)}), "
            "support AS (SELECT l.mask, coalesce(sum(pat.n), 0)::BIGINT AS n FROM (SELECT DISTINCT mask FROM listed) l "
            "LEFT JOIN pat ON (pat.mask & l.mask) = l.mask GROUP BY 1), "
            f"ranked AS (SELECT row_number() OVER (ORDER BY pin, CASE WHEN pin = {len(PINNED_LABELS)} THEN -n ELSE 0 END, pos)::INT AS rank, "
            f"label, features, n, pin < {len(PINNED_LABELS)} AS pinned FROM listed JOIN support USING (mask))")


def _availability(spark, d):
    return completeness.featureset_availability(samples(spark, d), list(BASE_FEATURES), resolve=SHORT.get)


@register("SELECT rank, label, array_to_string(features, '|') AS features, n, pinned FROM ranked", _availability_sql())
def featureset_availability(spark, d):
    return _availability(spark, d).withColumn("features", F.array_join("features", "|"))


@register("""SELECT rank, label, n, len(features)::INT AS dimension, 2 AS layers,
  greatest(32, least(128, pow(2e0, round_even(log2(len(features) * 8e0), 0))))::INT AS hidden_dim,
  greatest(2, least(6, ceil(len(features) / 3e0)))::INT AS latent_dim,
  greatest(64, least(256, pow(2e0, round_even(log2(greatest(n / 500e0, 1e0)), 0))))::INT AS batch_size FROM ranked""", _availability_sql())
def feature_set_plan(spark, d):
    return completeness.feature_set_plan(_availability(spark, d)).drop("features", "pinned")


@register(" UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'skewness({c})')} AS skewness, min({c}) AS min, count({c}) AS n FROM samples" for c in NUMERIC))
def skewness_g1(spark, d):
    return rounded(features.skewness_g1(samples(spark, d), NUMERIC), "skewness")


@register(f"SELECT sample_id, {r('ln(1 + na)')} AS na_log, {r('ln(1 + ca)')} AS ca_log, ph, temperature FROM samples")
def log_transform(spark, d):
    df, names = features.log_transform(samples(spark, d), ["na", "ca", "ph", "temperature"])
    return rounded(df.select("sample_id", *names), *[n for n in names if n.endswith("_log")])


_GRID = ", ".join(repr(float(p)) for p in np.linspace(0.0, 1.0, 1000))


@register(" UNION ALL ".join(f"""SELECT '{c}' AS feature, i::INT AS i, {r('v')} AS value FROM (
  SELECT unnest(q) AS v, unnest(range(1000)) AS i FROM (SELECT quantile_cont({c}, [{_GRID}]) AS q FROM samples))""" for c in ("na", "ph")))
def gaussian_quantile_grid(spark, d):
    grid = features.quantile_grid(samples(spark, d), ["na", "ph"], 1000)
    return rounded(grid.select("feature", F.posexplode("quantiles").alias("i", "value")), "value")


def _horner(coefficients, x: str) -> str:
    text = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r}::DOUBLE)"
    return text


def normal_sql(g: str, t: str) -> str:
    """AS 241: the normal quantile of p, of which ``g`` is p - 0.5 and ``t`` the root of -ln of the smaller side."""
    centre, middle, tail = (tuple(_horner(p, x) for p in pair) for pair, x in zip(
        (normal._CENTRE, normal._MIDDLE, normal._TAIL), (f"(0.180625 - {g} * {g})", f"({t} - 1.6)", f"({t} - 5.0)")))
    return (f"CASE WHEN abs({g}) <= 0.425 THEN {g} * {centre[0]} / {centre[1]} WHEN {t} <= 5 THEN sign({g}) * {middle[0]} / {middle[1]} "
            f"ELSE sign({g}) * {tail[0]} / {tail[1]} END")


def _scores_sql(c: str) -> str:
    """Normal scores of one column: bracket each value in the quantile grid, then AS 241."""
    return f"""SELECT sample_id, '{c}' AS feature, {normal_sql("g", "t")} AS score FROM (
      SELECT sample_id, p - 0.5 AS g, sqrt(-ln(least(p, 1 - p))) AS t FROM (
        SELECT sample_id, least(greatest(CASE WHEN v <= q[1] THEN 0e0 WHEN v >= q[1000] THEN 1e0
          WHEN q[below] = q[above] THEN (below + above - 2) / 2e0 / 999e0
          ELSE (below - 1) / 999e0 + (v - q[below]) / (q[above] - q[below]) / 999e0 END, 1e-7), 1 - 1e-7) AS p FROM (
          SELECT sample_id, v, q, len(list_filter(q, lambda x: x <= v)) AS below, len(list_filter(q, lambda x: x < v)) + 1 AS above FROM (
            SELECT sample_id, {c} AS v, (SELECT quantile_cont({c}, [{_GRID}]) FROM samples) AS q FROM samples WHERE {c} IS NOT NULL))))"""


@register(f"SELECT sample_id, feature, {r('score', 5)} AS score FROM (" + " UNION ALL ".join(_scores_sql(c) for c in ("na", "ph")) + ")")
def gaussianize(spark, d):
    df, names = features.gaussianize(samples(spark, d), ["na", "ph"])
    long = unpivot(df, names, ["sample_id"], value="score").where("score is not null")
    return rounded(long.withColumn("feature", F.regexp_replace("feature", "_gauss$", "")), "score", digits=5)


@register()
def preprocess_(spark, d):
    df, report = preprocess(samples(spark, d), NUMERIC, ["latitude", "longitude", "database_number", "rock_type", "period"], "period", "sample_id")
    return df


@register("""SELECT * FROM (VALUES ('na', 'na_log_gauss', FALSE), ('ph', 'ph_gauss', FALSE), ('fe', 'fe', TRUE), ('xx', NULL, FALSE)) v(feature, "column", is_raw),
  LATERAL (SELECT CASE feature WHEN 'na' THEN (SELECT count(na) FROM samples) WHEN 'ph' THEN (SELECT count(ph) FROM samples)
  WHEN 'fe' THEN (SELECT count(fe) FROM samples) ELSE 0 END AS n_values)""")
def select_features(spark, d):
    df = samples(spark, d).select("na", F.col("na").alias("na_gauss"), F.col("na").alias("na_log_gauss"), "ph", F.col("ph").alias("ph_gauss"), "fe")
    return features.mapping_table(df, ["na", "ph", "fe", "xx"]).withColumn("is_raw", F.coalesce("is_raw", F.lit(False)))


SPLIT_SQL = ("split AS (SELECT *, CASE WHEN substr(md5('42:' || CAST(sample_id AS STRING)), 1, 8) < '19999999' THEN 'Test' ELSE 'Train' END AS split "
             "FROM samples)")


@register("SELECT sample_id, split FROM split", SPLIT_SQL)
def train_test_split(spark, d):
    return samples(spark, d).select("sample_id", features.split_label(F.col("sample_id")).alias("split"))


@register("SELECT sample_id, (('0x' || substr(md5('42:' || CAST(sample_id AS STRING)), 9, 7))::BIGINT % 5)::INT AS fold FROM split WHERE split = 'Train'", SPLIT_SQL)
def kfold(spark, d):
    train = samples(spark, d).where(features.split_label(F.col("sample_id")) == "Train")
    return train.select("sample_id", features.fold_of(F.col("sample_id")).alias("fold"))


def _train(spark, d):
    return samples(spark, d).withColumn("split", features.split_label(F.col("sample_id")))


@register("SELECT sample_id, " + ", ".join(f"{r(f'({c} - {c}_m) / {c}_s')} AS {c}" for c in ("na", "ph")) + " FROM split, (SELECT "
          + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in ("na", "ph")) + " FROM split WHERE split = 'Train')", SPLIT_SQL)
def standardize(spark, d):
    df = _train(spark, d)
    scaling = features.standardize(df.where("split = 'Train'"), ["na", "ph"])
    return rounded(scaling.transform(df).select("sample_id", "na", "ph"), "na", "ph")


@register("SELECT sample_id, round(na, 6) + 0e0 AS na, round(ph, 6) + 0e0 AS ph FROM samples")
def inverse_standardize(spark, d):
    df = samples(spark, d).select("sample_id", "na", "ph")
    scaling = features.standardize(df, ["na", "ph"])
    return rounded(scaling.inverse(scaling.transform(df)), "na", "ph")


@register("SELECT sample_id, " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {r(f'least(greatest({c}, {c}_l), {c}_h)')} END AS {c}" for c in ("na", "mg"))
          + " FROM split, (SELECT " + ", ".join(f"quantile_cont({c}, 0.02) AS {c}_l, quantile_cont({c}, 0.98) AS {c}_h" for c in ("na", "mg"))
          + " FROM split WHERE split = 'Train')", SPLIT_SQL)
def quantile_clip(spark, d):
    df = _train(spark, d)
    bounds = features.quantile_bounds(df.where("split = 'Train'"), ["na", "mg"])
    return rounded(features.quantile_clip(df, bounds).select("sample_id", "na", "mg"), "na", "mg")


@register("SELECT sample_id, " + ", ".join(f"({c} - {c}_l) / {c}_w AS {c}" for c in ("na", "ph")) + " FROM samples, (SELECT "
          + ", ".join(f"min({c}) AS {c}_l, max({c}) - min({c}) AS {c}_w" for c in ("na", "ph")) + " FROM samples)")
def min_max_scale(spark, d):
    df = samples(spark, d).select("sample_id", "na", "ph")
    return features.min_max_scale(df, features.min_max(df, ["na", "ph"]))


_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in BASE)


@register(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'covar_samp({a}, {b})')} AS value FROM samples WHERE {_COMPLETE}"
                             for i, a in enumerate(BASE) for b in BASE[i:]))
def covariance(spark, d):
    return rounded(features.covariance(samples(spark, d), BASE), "value")


@register()
def pca2(spark, d):
    df = samples(spark, d)
    components = features.pca(df, BASE)
    return features.pca_projection(df.dropna("any", subset=BASE), BASE, components).select("sample_id", "pc1", "pc2")


@register(f"""SELECT sample_id, {r('(na - ma) * x1 + (fe - mb) * y1')} AS pc1, {r('(na - ma) * x2 + (fe - mb) * y2')} AS pc2 FROM pairs, axes""",
          """pairs AS (SELECT sample_id, na, fe FROM samples WHERE na IS NOT NULL AND fe IS NOT NULL),
moments AS (SELECT avg(na) AS ma, avg(fe) AS mb, covar_samp(na, na) AS a, covar_samp(na, fe) AS b, covar_samp(fe, fe) AS c FROM pairs),
top AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS l FROM moments),
raw_axis AS (SELECT *, CASE WHEN a >= c THEN l - c ELSE b END AS x0, CASE WHEN a >= c THEN b ELSE l - a END AS y0 FROM top),
unit_axis AS (SELECT *, x0 / sqrt(x0 * x0 + y0 * y0) AS x, y0 / sqrt(x0 * x0 + y0 * y0) AS y FROM raw_axis),
axes AS (SELECT ma, mb, x * sign(CASE WHEN abs(x) >= abs(y) THEN x ELSE y END) AS x1, y * sign(CASE WHEN abs(x) >= abs(y) THEN x ELSE y END) AS y1,
  -y * sign(CASE WHEN abs(y) >= abs(x) THEN -y ELSE x END) AS x2, x * sign(CASE WHEN abs(y) >= abs(x) THEN -y ELSE x END) AS y2 FROM unit_axis)""")
def pca_of_two(spark, d):
    """Two columns, whose axes have a closed form."""
    df = samples(spark, d).dropna("any", subset=["na", "fe"])
    found = features.pca_projection(df, ["na", "fe"], features.pca(df, ["na", "fe"])).select("sample_id", "pc1", "pc2")
    return rounded(found, "pc1", "pc2")


@register("SELECT sample_id, feature, value FROM samples UNPIVOT INCLUDE NULLS (value FOR feature IN (na, ph, temperature))")
def unpivot_features(spark, d):
    return unpivot(samples(spark, d), ["na", "ph", "temperature"], ["sample_id"])


@register("SELECT base, count(*) AS n FROM (SELECT CASE sample_id % 3 WHEN 0 THEN 'Na_in_mmol/L' WHEN 1 THEN 'pH' ELSE 'F' END AS base FROM samples) GROUP BY 1")
def transform_suffixes(spark, d):
    from ..functions.cleaning import strip_transforms
    name = F.expr("CASE sample_id % 3 WHEN 0 THEN 'Na_in_mmol/L_log_gauss' WHEN 1 THEN 'pH_gauss' ELSE 'F_boxcox' END")
    return samples(spark, d).groupBy(strip_transforms(name).alias("base")).agg(F.count(q("sample_id")).alias("n"))
