"""Queries over filters, profiles, histograms, rankings and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import BALANCE_COLUMNS, NUMERIC, raw_samples, samples
from ..operators import examples, filters, histograms, profile, ranking
from ..schema import q
from .registry import IBE_SQL, register, rounded, r


def balanced(spark, d, **options):
    return filters.ionic_balance_error(samples(spark, d), BALANCE_COLUMNS, **options)


_KEPT = "coalesce(abs(ibe) <= 5 AND (temperature >= 10 OR temperature IS NULL), FALSE)"


@register("SELECT sample_id, ibe FROM ibe", IBE_SQL)
def ionic_balance_error(spark, d):
    return balanced(spark, d).select("sample_id", "ibe")


@register("""SELECT sample_id, CASE WHEN c + a >= 1e-9 THEN (c - a) / (c + a) * 100e0 END AS ibe,
  na IS NOT NULL AND mg IS NOT NULL AND ca IS NOT NULL AND cl IS NOT NULL AND hco3 IS NOT NULL AND so4 IS NOT NULL AND c + a >= 1e-9 AS complete FROM (
  SELECT *, coalesce(na, 0e0) / 22.99e0 * 1e0 + coalesce(ca, 0e0) / 1000e0 * 2e0 + coalesce(mg, 0e0) * 2e0 AS c,
         coalesce(cl, 0e0) * 1e0 + coalesce(hco3, 0e0) * 1e0 + coalesce(so4, 0e0) * 2e0 AS a FROM samples)""")
def ionic_balance_units(spark, d):
    ions = BALANCE_COLUMNS | {"Na": ("na", "mg/L"), "Ca": ("ca", "umol/L")}
    df = filters.ionic_balance_error(samples(spark, d), ions)
    df = filters.ionic_balance_error(df, ions, "_strict", require_all=True)
    return df.select("sample_id", "ibe", F.col("_strict").isNotNull().alias("complete"))


@register(f"SELECT sample_id, database_name, temperature, na, ca, mg, cl, so4, hco3, ibe FROM ibe WHERE {_KEPT}", IBE_SQL)
def filter_ibe_temperature(spark, d):
    kept = filters.filter_ibe_temperature(balanced(spark, d), temperature="temperature")
    return kept.select("sample_id", "database_name", "temperature", "na", "ca", "mg", "cl", "so4", "hco3", "ibe")


@register("""SELECT sample_id, 'strict' AS variant, (c - a) / (c + a) * 100e0 AS ibe FROM (
  SELECT sample_id, coalesce(na, 0e0) * (1e0 / 22.99e0) + coalesce(ca, 0e0) * 2e0 + coalesce(mg, 0e0) * 0e0 AS c,
    coalesce(cl, 0e0) * 1e0 + coalesce(hco3, 0e0) * 1e0 + coalesce(so4, 0e0) * 2e0 AS a FROM samples) WHERE c + a > 1e-4
  UNION ALL SELECT sample_id, 'plain', (cations - anions) / (cations + anions) * 100e0 FROM balanced WHERE cations + anions > 0.1e0""", IBE_SQL)
def filter_ibe_validity(spark, d):
    df = samples(spark, d)
    ions = BALANCE_COLUMNS | {"Na": ("na", "ppm"), "Mg": ("mg", "furlong")}
    strict = filters.filter_ibe_validity(df, "strict", ions).select("sample_id", F.lit("strict").alias("variant"), "ibe")
    plain = filters.filter_ibe_validity(df, "plain", BALANCE_COLUMNS).select("sample_id", F.lit("plain").alias("variant"), "ibe")
    return strict.unionByName(plain)


@register("""(SELECT sample_id, ibe FROM ibe WHERE ibe > 40 ORDER BY sample_id LIMIT 3)
  UNION ALL (SELECT sample_id, ibe FROM ibe WHERE ibe < -40 ORDER BY sample_id LIMIT 3)""", IBE_SQL)
def filter_extremes(spark, d):
    return filters.filter_extremes(balanced(spark, d).select("sample_id", "ibe"), 40.0)


@register("SELECT sample_id, latitude, longitude FROM samples WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def filter_valid_coordinates(spark, d):
    return filters.filter_valid_coordinates(samples(spark, d).select("sample_id", "latitude", "longitude"), "latitude", "longitude")


@register("SELECT sample_id FROM samples WHERE na IS NOT NULL AND mg IS NOT NULL AND fe IS NOT NULL AND ph IS NOT NULL AND temperature IS NOT NULL")
def complete_cases(spark, d):
    return filters.complete_cases(samples(spark, d), ["na", "mg", "fe", "ph", "temperature"]).select("sample_id")


@register("SELECT sample_id FROM samples WHERE fe IS NOT NULL OR ph IS NOT NULL OR depth_m IS NOT NULL")
def any_present(spark, d):
    return filters.any_present(samples(spark, d), ["fe", "ph", "depth_m"]).select("sample_id")


@register("SELECT sample_id, depth_m FROM samples WHERE depth_m BETWEEN 0 AND 500")
def filter_range(spark, d):
    return filters.filter_range(samples(spark, d), "depth_m", 0.0, 500.0).select("sample_id", "depth_m")


@register("SELECT sample_id, NULLIF(period, 'Unknown') AS period FROM samples")
def null_sentinel(spark, d):
    return filters.null_sentinel(samples(spark, d), "period").select("sample_id", "period")


@register("SELECT count(period) AS before, count(NULLIF(period, 'Unknown')) AS after, count(period) - count(NULLIF(period, 'Unknown')) AS removed FROM samples")
def sentinel_report(spark, d):
    return filters.sentinel_report(samples(spark, d), "period")


@register("SELECT well_or_spring_name, count(*) AS n FROM samples GROUP BY 1 HAVING count(*) >= 50")
def require_min_count(spark, d):
    return filters.require_min_count(samples(spark, d), ["well_or_spring_name"], 50)


@register(f"""SELECT count(*) AS original, count(*) FILTER ({_KEPT}) AS kept, count(*) - count(*) FILTER ({_KEPT}) AS removed,
  (count(*) - count(*) FILTER ({_KEPT}))::DOUBLE / count(*) * 100e0 AS percent_removed FROM ibe""", IBE_SQL)
def filter_report(spark, d):
    return filters.filter_report(balanced(spark, d), filters.quality_condition(temperature="temperature"))


@register("""SELECT count(ibe) AS total, count(*) FILTER (abs(ibe) <= 5) AS good, count(ibe) - count(*) FILTER (abs(ibe) <= 5) AS bad,
  (count(*) FILTER (abs(ibe) <= 5))::DOUBLE / count(ibe) AS good_share, (count(ibe) - count(*) FILTER (abs(ibe) <= 5))::DOUBLE / count(ibe) AS bad_share
  FROM ibe WHERE cations + anions > 0.1e0""", IBE_SQL)
def ibe_quality_report(spark, d):
    return filters.ibe_quality_report(balanced(spark, d, variant="plain"))


@register(f"""SELECT count(*) AS total, count(*) FILTER (temperature < 10) AS below, count(*) FILTER (temperature >= 10) AS above,
  (count(*) FILTER (temperature < 10))::DOUBLE / count(*) AS below_share, (count(*) FILTER (temperature >= 10))::DOUBLE / count(*) AS above_share,
  {r('avg(temperature)')} AS mean FROM samples WHERE temperature BETWEEN 0 AND 500""")
def temperature_share(spark, d):
    df = filters.filter_range(samples(spark, d), "temperature", 0.0, 500.0)
    return rounded(filters.temperature_share(df, "temperature"), "mean")


_COLUMNS = ["sample_id", "location", "latitude", "longitude", "depth_m", "period", "temperature", "ph", "na", "mg", "fe", "rock_type"]


@register(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n_values, count(*) - count({c}) AS n_null FROM samples" for c in _COLUMNS))
def column_completeness(spark, d):
    return profile.column_completeness(samples(spark, d).select(*_COLUMNS))


def _quantiles(column: str) -> str:
    names = ["p01", "p25", "median", "p75", "p99"]
    return ", ".join(f"{r(f'quantile_cont({column}, {p})')} AS {n}" for n, p in zip(names, (0.01, 0.25, 0.5, 0.75, 0.99)))


@register(" UNION ALL ".join(f"""SELECT '{c}' AS feature, count(*) AS n, count({c}) AS n_values, count(*) - count({c}) AS n_null,
  count({c}) / count(*) AS share, min({c}) AS min, max({c}) AS max, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, {_quantiles(c)}
  FROM samples""" for c in NUMERIC))
def column_profile(spark, d):
    df = profile.column_profile(samples(spark, d), NUMERIC)
    return rounded(df, "mean", "std", "p01", "p25", "median", "p75", "p99")


_FILLED = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in _COLUMNS)


@register(f"""SELECT b::INT AS bin, count(p) AS n, (SELECT count(*) FROM filled WHERE p = 100)::BIGINT AS complete_rows,
  count(p) / (SELECT count(*) FROM filled) * 100e0 AS percent
  FROM range(10) g(b) LEFT JOIN filled ON greatest(ceil(p / 10) - 1, 0) = b GROUP BY 1""",
          f"filled AS (SELECT ({_FILLED})::DOUBLE / {len(_COLUMNS)}e0 * 100e0 AS p FROM samples)")
def row_completeness_histogram(spark, d):
    return profile.row_completeness_histogram(samples(spark, d).select(*_COLUMNS))


_HIST = """stats AS (SELECT '{c}' AS feature, min({c}) AS low, max({c}) AS mx, quantile_cont({c}, 0.98) AS p98, quantile_cont({c}, 0.99) AS p99, count({c}) AS n FROM samples)"""


def _histogram_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, {r('low')} AS low, {r('high')} AS high, bins, bin::INT AS bin, count(*) AS n FROM (
      SELECT *, least(floor((v - low) / ((high - low) / bins)), bins - 1) AS bin FROM (SELECT {c} AS v FROM samples) s, (
        SELECT low, greatest(CASE WHEN mx > p99 * 10 THEN p98 ELSE p99 END, low) AS high,
          (CASE WHEN n < 30 THEN greatest(5, n // 2) ELSE least(60, floor(sqrt(n))) END)::INT AS bins
        FROM (SELECT min({c}) AS low, max({c}) AS mx, quantile_cont({c}, 0.98) AS p98, quantile_cont({c}, 0.99) AS p99, count({c}) AS n FROM samples))
      WHERE v BETWEEN low AND high) GROUP BY ALL"""


@register(" UNION ALL ".join(_histogram_sql(c) for c in ("temperature", "ph", "na", "cl")))
def histogram(spark, d):
    return rounded(histograms.histogram(samples(spark, d), ["temperature", "ph", "na", "cl"]), "low", "high")


def _fd_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, {r('low')} AS low, {r('high')} AS high, bins, least(floor((v - low) / ((high - low) / bins)), bins - 1)::INT AS bin,
      count(*) AS n FROM (SELECT {c} AS v FROM samples) s, (
        SELECT low, high, (CASE WHEN w > 0 THEN ceil((high - low) / w) ELSE 1 END)::INT AS bins FROM (
          SELECT any_value(low) AS low, any_value(high) AS high,
            2e0 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / pow(count({c})::DOUBLE, {1 / 3!r}) AS w
          FROM samples, (SELECT quantile_cont({c}, 0.01) AS low, quantile_cont({c}, 0.99) AS high FROM samples) WHERE {c} BETWEEN low AND high))
      WHERE v BETWEEN low AND high GROUP BY ALL"""


@register(" UNION ALL ".join(_fd_sql(c) for c in ("temperature", "na")))
def histogram_fd(spark, d):
    return rounded(histograms.histogram_fd(samples(spark, d), ["temperature", "na"]), "low", "high")


@register("""SELECT CASE WHEN abs(ibe) <= 5 THEN 'good' ELSE 'outlier' END AS series,
  least(floor((ibe - -100e0) / 2e0), 99)::INT AS bin, count(*) AS n FROM ibe WHERE ibe BETWEEN -100 AND 100 GROUP BY ALL""", IBE_SQL)
def histogram_fixed(spark, d):
    series = F.when(F.abs("ibe") <= 5, "good").otherwise("outlier")
    return histograms.histogram_fixed(balanced(spark, d), "ibe", -100.0, 100.0, 100, series)


@register("SELECT year(sampled_at)::INT AS year, count(*) AS n FROM samples GROUP BY 1")
def counts_by_year(spark, d):
    return profile.counts_by_year(samples(spark, d).select(F.col("sampled_at").cast("string").alias("t")), "t")


@register("""SELECT category, n, FALSE AS is_rest FROM ranked WHERE i <= 20 UNION ALL
  SELECT NULL, sum(n)::BIGINT, TRUE FROM ranked WHERE i > 20 HAVING sum(n) > 0""",
          """ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, category) AS i FROM (
  SELECT location AS category, count(*) AS n FROM samples WHERE location IS NOT NULL GROUP BY 1))""")
def category_topk(spark, d):
    return profile.category_topk(samples(spark, d), "location")


@register(f"""SELECT database_number, count(*) AS n, count(temperature) AS n_values, count(*) - count(temperature) AS n_missing,
  count(temperature) / count(*) * 100e0 AS percent_values, (count(*) - count(temperature)) / count(*) * 100e0 AS percent_missing,
  min(temperature) AS min, max(temperature) AS max, {r('avg(temperature)')} AS mean, first(database_name ORDER BY sample_id) AS name,
  {r('median(temperature)')} AS median FROM samples GROUP BY 1""")
def summary_by_source(spark, d):
    df = profile.summary_by_source(samples(spark, d), "temperature", "database_number", "database_name")
    return rounded(df, "mean", "median")


@register("""SELECT database_name, count(*) AS n, count(rock_type) AS n_values, count(rock_type) / count(*) * 100e0 AS percent,
  coalesce(string_agg(DISTINCT rock_type, ', ' ORDER BY rock_type), '') AS categories FROM samples GROUP BY 1""")
def category_coverage_by_source(spark, d):
    return profile.category_coverage_by_source(samples(spark, d), "rock_type", "database_name")


@register("SELECT trim(lithology) AS value, count(*) AS n FROM raw GROUP BY 1")
def value_counts(spark, d):
    return profile.value_counts(raw_samples(spark, d), "lithology")


@register(f"""SELECT cell, lat_cell, lon_cell, count(*) AS n, {r('avg(latitude)')} AS latitude, {r('avg(longitude)')} AS longitude FROM (
  SELECT latitude, longitude, s.cell, CASE WHEN s.cell = 0 THEN 0 ELSE floor(latitude / s.cell) END::BIGINT AS lat_cell,
    CASE WHEN s.cell = 0 THEN 0 ELSE floor(longitude / s.cell) END::BIGINT AS lon_cell
  FROM samples, (VALUES (0e0), (45e0), (15e0), (5e0)) s(cell) WHERE latitude IS NOT NULL AND longitude IS NOT NULL) GROUP BY 1, 2, 3""")
def geo_summary(spark, d):
    return rounded(profile.geo_summary(samples(spark, d), "latitude", "longitude"), "latitude", "longitude")


@register("SELECT DISTINCT period AS value FROM samples WHERE period IS NOT NULL")
def distinct_values(spark, d):
    return profile.distinct_values(samples(spark, d), "period")


@register("""SELECT target, sign, database_name, distance, sample_id, ibe, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY target, sign ORDER BY distance, sample_id) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY target, sign, database_name ORDER BY distance, sample_id) AS i FROM (
      SELECT t.target, CASE WHEN ibe > 0 THEN 1 ELSE -1 END AS sign, database_name, sample_id, ibe,
        abs(ibe - t.target * CASE WHEN ibe > 0 THEN 1 ELSE -1 END) AS distance
      FROM ibe, (VALUES (100e0), (75e0), (50e0), (25e0), (10e0), (5e0)) t(target) WHERE ibe <> 0)) WHERE i = 1) WHERE rank <= 5""", IBE_SQL)
def nearest_to_target_per_source(spark, d):
    return examples.nearest_to_target_per_source(balanced(spark, d), n=10, source="database_name")


@register("SELECT sample_id, na FROM samples ORDER BY md5('0:' || CAST(sample_id AS STRING)) LIMIT 700")
def sample_n(spark, d):
    return examples.sample_n(samples(spark, d).select("sample_id", "na"), "sample_id", 700)


@register("""SELECT sample_id, ph FROM (SELECT *, row_number() OVER (ORDER BY md5('7:' || CAST(sample_id AS STRING))) AS i, count(*) OVER () AS n
  FROM samples) WHERE i <= greatest(1, n // 10)""")
def sample_fraction(spark, d):
    return examples.sample_fraction(samples(spark, d).select("sample_id", "ph"), "sample_id", 10, 7)


@register("SELECT sample_id, avg_rank, n, before, total FROM (SELECT min(sample_id) AS sample_id, na, min(rk) + (count(*) - 1) / 2.0e0 AS avg_rank, "
          "count(*) AS n, min(rk) - 1 AS before, any_value(t) AS total FROM (SELECT sample_id, na, rank() OVER (ORDER BY na) AS rk, "
          "count(*) OVER () AS t FROM samples WHERE na IS NOT NULL) GROUP BY na)")
def average_rank(spark, d):
    df = samples(spark, d).where("na is not null")
    first = df.groupBy("na").agg(F.min("sample_id").alias("sample_id"))
    ranks = ranking.average_rank(df, [], "na")
    return ranks.join(first, "na").select(
        "sample_id", "avg_rank", "n", "before", "total")


@register("SELECT sample_id, na, row_number() OVER (ORDER BY na DESC NULLS LAST, sample_id) AS place FROM samples "
          "ORDER BY na DESC NULLS LAST, sample_id LIMIT 20")
def order_by(spark, d):
    top = samples(spark, d).select("sample_id", "na").orderBy(F.desc_nulls_last("na"), "sample_id").limit(20)
    return ranking.global_row_number(top, F.desc_nulls_last("na"), "sample_id", output="place", start=1)


@register("SELECT sample_id, na FROM samples ORDER BY sample_id LIMIT 50")
def limit_head(spark, d):
    return samples(spark, d).select("sample_id", "na").orderBy("sample_id").limit(50)


@register(f"SELECT * FROM (SELECT sample_id, 'high' AS side, ibe FROM ibe WHERE ibe > 30) UNION ALL "
          f"SELECT sample_id, 'low', ibe FROM ibe WHERE ibe < -30", IBE_SQL)
def union_extremes(spark, d):
    return examples.union_extremes(balanced(spark, d).select("sample_id", "ibe"), 30.0)
