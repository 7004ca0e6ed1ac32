"""A messy sample table derived from the test tables, as text both engines run.

One raw sample per event: text numbers in µg/L with missing-value tokens and comparison marks, depths in
feet, free-text lithology. ``samples`` is the cleaned form most queries start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.cleaning import clean_numeric, parse_numbers
from .operators.mapping import classify_by_threshold, null_negatives
from .session import spread, workspace
from .sources.folders import exists

RAW_SQL = """
SELECT e.event_id AS sample_id,
       CASE WHEN e.event_id % 3 = 0 THEN 1 ELSE CAST(e.event_id % 13 + 1 AS INT) END AS database_number,
       n.n_name AS location,
       'well_' || CAST(e.user_id AS STRING) AS well_or_spring_name,
       CASE WHEN e.event_id % 29 = 0 THEN NULL ELSE CAST(e.event_id % 180 - 90 AS DOUBLE) + 0.5e0 END AS latitude,
       CASE WHEN e.event_id % 31 = 0 THEN NULL ELSE CAST(e.event_id % 360 - 180 AS DOUBLE) + 0.25e0 END AS longitude,
       CASE WHEN e.event_id % 3 = 0 THEN NULL ELSE CAST(e.event_id % 5000 AS STRING) END AS depth_ft,
       CASE e.event_id % 8 WHEN 0 THEN 'Sandstone; Shale' WHEN 1 THEN 'Limestone & dolomite' WHEN 2 THEN 'SS'
            WHEN 3 THEN 'unknown' WHEN 4 THEN NULL WHEN 5 THEN '' WHEN 6 THEN 'chert or sandstone' ELSE 'granitic' END AS lithology,
       CASE e.event_id % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Triassic' WHEN 2 THEN 'Jurassic' END AS period,
       CASE WHEN e.event_id % 11 = 0 THEN 'N/D' WHEN e.event_id % 11 = 1 THEN '  ' ELSE CAST(e.event_id % 97 AS STRING) END AS temperature_c,
       CASE WHEN e.event_id % 5 = 0 THEN NULL ELSE CAST(5.0e0 + CAST(e.event_id % 40 AS DOUBLE) / 10.0e0 AS DOUBLE) END AS ph,
       CASE WHEN e.event_id % 17 = 0 THEN 'n/d' WHEN e.event_id % 17 = 1 THEN '<' || CAST(CAST(FLOOR(e.value * 22989.769e0) AS BIGINT) AS STRING)
            WHEN e.event_id % 17 = 2 THEN '-5' ELSE CAST(CAST(FLOOR(e.value * 22989.769e0) AS BIGINT) AS STRING) END AS na_ugl,
       CAST(CAST(FLOOR(e.value * (0.25e0 + CAST(e.event_id % 19 - 9 AS DOUBLE) / 60.0e0) * 40078e0) AS BIGINT) AS STRING) AS ca_ugl,
       CASE WHEN e.event_id % 7 = 0 THEN '' ELSE CAST(CAST(FLOOR(e.value * (0.125e0 + CAST(e.event_id % 23 - 11 AS DOUBLE) / 120.0e0) * 24305e0) AS BIGINT) AS STRING) END AS mg_ugl,
       CAST(CAST(FLOOR(e.value * (1.0e0 + CAST(e.event_id % 41 - 20 AS DOUBLE) / 40.0e0) * 35450e0) AS BIGINT) AS STRING) AS cl_ugl,
       CASE WHEN e.event_id % 37 = 0 THEN NULL ELSE CAST(CAST(FLOOR(e.value * (0.25e0 + CAST(e.event_id % 43 - 21 AS DOUBLE) / 150.0e0) * 96060e0)
            AS BIGINT) AS STRING) END AS so4_ugl,
       CASE WHEN e.event_id % 47 = 0 THEN 'n/d' ELSE CAST(CAST(FLOOR(e.value * (0.25e0 + CAST(e.event_id % 53 - 26 AS DOUBLE) / 200.0e0) * 61016.8e0)
            AS BIGINT) AS STRING) END AS hco3_ugl,
       CASE WHEN e.event_id % 6 = 0 THEN NULL ELSE '~' || CAST(e.event_id % 900 AS STRING) END AS fe_ugl,
       e.ts AS sampled_at
FROM {events} e LEFT JOIN {nation} n ON e.user_id % 25 = n.n_nationkey
"""

IONS = {"na": "Na", "ca": "Ca", "mg": "Mg", "cl": "Cl", "so4": "SO4", "hco3": "HCO3", "fe": "Fe"}
BALANCE_COLUMNS = {"Na": ("na", "mmol/L"), "Ca": ("ca", "mmol/L"), "Mg": ("mg", "mmol/L"),
                   "Cl": ("cl", "mmol/L"), "HCO3": ("hco3", "mmol/L"), "SO4": ("so4", "mmol/L")}
BASE = ["na", "mg", "ca", "cl", "so4", "hco3"]
NUMERIC = ["depth_m", "temperature", "ph", *IONS]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messy table: every event is one raw sample."""
    return spark.sql(RAW_SQL, events=table(spark, sf_dir, "events"), nation=table(spark, sf_dir, "nation"))


_WRITTEN: dict[tuple[str, str], tuple[str, object]] = {}


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned table, written once per application and read back as Parquet.

    Analyses read it many times and filter on derived columns. Left as a view, such filters would be pushed
    below the cleaning and repeat its expressions; as a table they prune columns and skip row groups.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN or not exists(spark, _WRITTEN[key][0]):
        df = spread(clean_samples(spark, sf_dir))
        path = workspace(spark, "silver")
        df.write.parquet(path)
        _WRITTEN[key] = path, df.schema
    path, schema = _WRITTEN[key]
    return spark.read.schema(schema).parquet(path)


def clean_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw to clean: numbers in mmol/L, negatives null, depth in metres, rock class from temperature."""
    from .schema import MOLAR_MASS

    text = {"depth_ft": "depth_m", "temperature_c": "temperature", **{f"{c}_ugl": c for c in IONS}}
    parsed = parse_numbers(raw_samples(spark, sf_dir), text, clean_numeric).withColumnsRenamed(text)
    numbers = parsed.select(
        "sample_id", "database_number", F.concat(F.lit("source_"), F.col("database_number").cast("string")).alias("database_name"),
        "location", "well_or_spring_name", "latitude", "longitude", "lithology", "period", "ph", "sampled_at",
        (F.col("depth_m") * 0.3048).alias("depth_m"), "temperature",
        *[(F.col(c) / 1000.0 / MOLAR_MASS[s]).alias(c) for c, s in IONS.items()])
    return classify_by_threshold(null_negatives(numbers, IONS), "temperature", 60.0, "Granite", "Sandstone", "rock_type")


def _clean(column: str) -> str:
    return (rf"TRY_CAST(NULLIF(trim(regexp_replace(regexp_replace(trim({column}), '\bN/?D\b', '', 'gi'), "
            rf"'[<>≈~]', '', 'g')), '') AS DOUBLE)")


def sql_samples() -> str:
    """Common table expressions ``raw`` and ``samples`` for the oracle engine."""
    from .schema import MOLAR_MASS

    ions = ", ".join(f"{_clean(c + '_ugl')} / 1000.0e0 / {MOLAR_MASS[s]}e0 AS {c}" for c, s in IONS.items())
    signed = ", ".join(f"CASE WHEN {c} >= 0 THEN {c} END AS {c}" for c in IONS)
    return f"""raw AS ({RAW_SQL.format(events="events", nation="nation")}),
numbers AS (
  SELECT sample_id, database_number, 'source_' || CAST(database_number AS STRING) AS database_name,
         location, well_or_spring_name, latitude, longitude, lithology, period, ph, sampled_at,
         {_clean("depth_ft")} * 0.3048e0 AS depth_m, {_clean("temperature_c")} AS temperature, {ions}
  FROM raw),
samples AS (
  SELECT sample_id, database_number, database_name, location, well_or_spring_name, latitude, longitude,
         lithology, period, ph, sampled_at, depth_m, temperature, {signed},
         CASE WHEN temperature > 60 THEN 'Granite' WHEN temperature <= 60 THEN 'Sandstone' END AS rock_type
  FROM numbers)"""
