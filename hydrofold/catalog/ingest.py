"""Queries over scans, cleaning, unit harmonisation, joins and sets."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..fixtures import BASE, IONS, raw_samples, samples
from ..functions.cleaning import clean_numeric, decimal_comma, is_censored, numeric
from ..operators import categories, joins, mapping as m
from ..operators import profile
from ..operators.profile import merge_reconciliation
from ..operators.ranking import global_row_number
from ..plans.acquire import acquire_source, union_sources
from ..schema import DISPLAY_NAMES, MOLAR_MASS, TARGET_COLUMNS, TARGET_TYPES, q, schema_table as schema_dimension
from ..session import workspace
from ..sources import folders, tables
from ..sources.vendors import SOURCES
from .registry import register, rounded, r

RAW_FIELDS = ("sample_id long, database_number int, location string, well_or_spring_name string, latitude double, "
              "longitude double, lithology string, period string, temperature_c string, na_ugl string")


def _raw_part(spark, d):
    return raw_samples(spark, d).select([f.split()[0] for f in RAW_FIELDS.split(", ")])


# CSV cannot tell an empty text from a missing one; the raw fixture's blanks are kept apart by quoting.
_AS_CSV = {"header": True, "emptyValue": '""', "nullValue": ""}


@register("SELECT sample_id, database_number, location, period, temperature_c, na_ugl FROM raw")
def scan_samples(spark, d):
    path = workspace(spark, "samples") + ".csv"
    _raw_part(spark, d).write.options(**_AS_CSV, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    schema = T._parse_datatype_string(RAW_FIELDS)
    return tables.scan_samples(spark, path, schema).select(
        "sample_id", "database_number", "location", "period", "temperature_c", "na_ugl")


@register("SELECT 'part_' || CAST(database_number AS STRING) AS \"Database_name\", count(*) AS n, sum(sample_id)::BIGINT AS key_sum "
          "FROM raw GROUP BY 1")
def scan_source_folder(spark, d):
    root = workspace(spark, "sources")
    parts = _raw_part(spark, d).where("database_number is not null")
    for number in range(1, 14):
        parts.where(F.col("database_number") == number).write.options(**_AS_CSV).csv(f"{root}/part_{number}")
    # Spark names its part files itself, so the folder stands for the file stem here.
    rows = tables.scan_source_folder(spark, root, T._parse_datatype_string(RAW_FIELDS))
    source = F.regexp_extract(F.col("_metadata.file_path"), r"(part_\d+)/[^/]*$", 1)
    return rows.select(source.alias("Database_name"), "sample_id").groupBy("Database_name").agg(
        F.count("*").alias("n"), F.sum("sample_id").alias("key_sum"))


@register("SELECT sample_id, na, ca FROM samples")
def latest_snapshot(spark, d):
    root = workspace(spark, "snapshots")
    df = samples(spark, d).select("sample_id", "na", "ca")
    tables.write_snapshot(df.where("na is not null"), root, "2025-01-01_00-00-00")
    tables.write_snapshot(df, root, "2025-06-01_00-00-00")
    return spark.read.schema(df.schema).parquet(folders.latest_snapshot(spark, root))


@register("SELECT sample_id, na, ca FROM samples WHERE na IS NOT NULL")
def latest_snapshot_by_time(spark, d):
    """The last one written, whatever the names say, of those that are not nearly empty."""
    root = workspace(spark, "snapshots")
    df = samples(spark, d).select("sample_id", "na", "ca")
    tables.write_snapshot(df, root, "2025-09-01_00-00-00")
    tables.write_snapshot(df.where("na is not null"), root, "2025-01-01_00-00-00")
    tables.write_snapshot(df.limit(1), root, "2025-03-01_00-00-00")
    return spark.read.schema(df.schema).parquet(folders.latest_snapshot(spark, root, by="time", min_bytes=4096))


@register("SELECT cl, so4, hco3 FROM samples")
def scan_pruned(spark, d):
    path = tables.write_snapshot(samples(spark, d), workspace(spark, "pruned"), "now")
    return tables.scan_pruned(spark.read.parquet(path), ["cl", "so4", "hco"])


@register("SELECT sample_id, database_number, location AS place, period AS stratigraphic_period FROM raw")
def read_and_map(spark, d):
    sheet = raw_samples(spark, d).select(
        F.col("sample_id").alias(" Sample_ID"), F.col("database_number").alias("Database  Number"),
        F.col("location").alias("NUTS2 Name "), F.col("period").alias("Period"), F.col("ph").alias("pH"))
    return m.read_and_map(sheet, {"sample_id": "sample_id", "database_number": "database_number", "nuts2_name": "place",
                                  "period": "stratigraphic_period", "not_there": "redox"})


@register("SELECT sample_id, na, database_number FROM samples")
def write_snapshot(spark, d):
    df = samples(spark, d).select("sample_id", "na", "database_number")
    path = tables.write_snapshot(df, workspace(spark, "gold"), "2025-01-01_00-00-00", ["database_number"])
    return spark.read.parquet(path)


@register("""SELECT sample_id, na_ugl AS dissolved_oxigen_mg_per_l, ph AS ph_value, location AS site_name FROM raw""")
def conform_headers(spark, d):
    sheet = raw_samples(spark, d).select(
        F.col("sample_id").alias("Sample ID"), F.col("na_ugl").alias(" Dissolved Oxygen\tmg per__l"),
        F.col("ph").alias("PH  Value"), F.col("location").alias("Site __Name"), F.col("ph").alias("ph_value"))
    return m.conform_headers(sheet)


@register("SELECT sample_id, latitude AS \"WGS84_latitude\", ph AS \"pH\" FROM raw")
def apply_mapping(spark, d):
    return m.apply_mapping(raw_samples(spark, d), {"Sample_ID": "sample_id", " latitude ": "WGS84_latitude", "PH": "pH", "x": "y"})


@register("""SELECT k AS source, t AS target, p AS present, n AS n_values FROM (
  SELECT 'sample_id' AS k, 'key' AS t, TRUE AS p, count(sample_id) AS n FROM raw UNION ALL
  SELECT 'na_ugl', 'Na_in_mg/L', TRUE, count(na_ugl) FROM raw UNION ALL
  SELECT 'redox', 'redox_potential_in_mV', FALSE, 0 FROM (SELECT count(*) FROM raw))""")
def mapping_report(spark, d):
    return m.mapping_report(raw_samples(spark, d), {"Sample ID": "key", "na_ugl": "Na_in_mg/L", "Redox": "redox_potential_in_mV"})


@register("""SELECT DISTINCT 'depth' AS missing_key, count(*) OVER () AS n_rows FROM raw
             UNION ALL SELECT DISTINCT 'redox', count(*) OVER () FROM raw""")
def missing_mapping_keys(spark, d):
    raw = raw_samples(spark, d)
    missing = m.missing_mapping_keys(raw, {"Sample ID": "k", "Redox": "r", "ph": "pH", "Depth": "d"})
    return raw.agg(F.count("*").alias("n_rows")).select(F.explode(F.array(*map(F.lit, missing))).alias("missing_key"), "n_rows")


_TARGET_SQL = {"sample_id": "sample_id", "location": "location", "well_or_spring_name": "well_or_spring_name",
               "WGS84_latitude": "latitude", "WGS84_longitude": "longitude", "pH": "ph", "temperature_in_c": "temperature",
               "depth_bgl_in_m": "depth_m", **{f"{IONS[c]}_in_mmol/L": c for c in IONS}}


def _long_names(spark, d):
    df = samples(spark, d)
    return df.select([q(c).alias(target) for target, c in _TARGET_SQL.items()])


def _target_sql(extra: dict[str, str] | None = None) -> str:
    source = {**_TARGET_SQL, **(extra or {})}
    cells = []
    for name, dtype in TARGET_TYPES.items():
        kind = {"string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER"}[dtype.simpleString()]
        cells.append(f'{source.get(name, f"CAST(NULL AS {kind})")} AS "{name}"')
    return ", ".join(cells)


@register(f"SELECT sample_id, {_target_sql()} FROM samples")
def complete_schema(spark, d):
    return m.complete_schema(_long_names(spark, d), keep=["sample_id"])


@register("""SELECT sample_id,
  CASE WHEN regexp_matches(temperature_c, '^\\s*$') OR contains(temperature_c, 'N/D') THEN NULL ELSE temperature_c END AS temperature_c,
  CASE WHEN regexp_matches(lithology, '^\\s*$') OR contains(lithology, 'N/D') THEN NULL ELSE lithology END AS lithology,
  CASE WHEN regexp_matches(na_ugl, '^\\s*$') OR contains(na_ugl, 'N/D') THEN NULL ELSE na_ugl END AS na_ugl FROM raw""")
def unify_nulls(spark, d):
    return m.unify_nulls(raw_samples(spark, d).select("sample_id", "temperature_c", "lithology", "na_ugl"))


_NUM = (r"TRY_CAST(NULLIF(trim(regexp_replace(regexp_replace(trim({0}), '\bN/?D\b', '', 'gi'), '[<>≈~]', '', 'g')), '') AS DOUBLE)")


@register(f"""SELECT sample_id, {_NUM.format('na_ugl')} AS na, {_NUM.format('fe_ugl')} AS fe, {_NUM.format('temperature_c')} AS t,
  coalesce(regexp_matches(na_ugl, '[<>]'), FALSE) AS na_censored FROM raw""")
def clean_numeric_(spark, d):
    return raw_samples(spark, d).select(
        "sample_id", clean_numeric(F.col("na_ugl")).alias("na"), clean_numeric(F.col("fe_ugl")).alias("fe"),
        clean_numeric(F.col("temperature_c")).alias("t"), is_censored(F.col("na_ugl")).alias("na_censored"))


@register("SELECT sample_id, TRY_CAST(na_ugl AS DOUBLE) AS na, TRY_CAST(temperature_c AS DOUBLE) AS t FROM raw")
def to_numeric_strict(spark, d):
    return raw_samples(spark, d).select("sample_id", numeric(F.col("na_ugl")).alias("na"), numeric(F.col("temperature_c")).alias("t"))


@register("SELECT sample_id, TRY_CAST(replace(replace(CAST(ph AS STRING), '.', ','), ',', '.') AS DOUBLE) AS ph FROM raw")
def decimal_comma_to_double(spark, d):
    text = F.replace(F.col("ph").cast("string"), F.lit("."), F.lit(","))
    return raw_samples(spark, d).select("sample_id", decimal_comma(text).alias("ph"))


@register(f"""SELECT sample_id, {_NUM.format('na_ugl')} / 22.989769e0 AS "Na_in_mmol/L",
  {_NUM.format('fe_ugl')} / 87.62e0 * 1000e0 AS "Sr_in_umol/L" FROM raw""")
def convert_units(spark, d):
    raw = raw_samples(spark, d).select("sample_id", F.col("na_ugl").alias("Na_in_mmol/L"), F.col("fe_ugl").alias("Sr_in_umol/L"))
    return m.convert_units(raw)


@register("""SELECT sample_id, ca_ugl AS "Ca_in_mg/L", na_ugl AS "F_in_mg/L", so4_ugl AS "Xy_in_mg/L",
  TRY_CAST(ca_ugl AS DOUBLE) / 40.078e0 AS "Ca_in_mmol/L", TRY_CAST(na_ugl AS DOUBLE) / 18.998e0 * 1000e0 AS "F_in_umol/L" FROM raw""")
def convert_units_by_name(spark, d):
    raw = raw_samples(spark, d)
    return m.convert_units_by_name(raw.select(
        "sample_id", F.col("ca_ugl").alias("Ca_in_mg/L"), F.col("na_ugl").alias("F_in_mg/L"), F.col("so4_ugl").alias("Xy_in_mg/L")))


@register("""SELECT sample_id, TRY_CAST(depth_ft AS DOUBLE) * 0.3048e0 AS depth, TRY_CAST(na_ugl AS DOUBLE) / 1000e0 AS na FROM raw""")
def prescale(spark, d):
    raw = raw_samples(spark, d).select("sample_id", F.col("depth_ft").alias("depth"), F.col("na_ugl").alias("na"))
    return m.prescale(m.prescale(raw, {"depth": 0.3048, "absent": 2.0}), {"na": 1000.0}, divide=True)


@register("SELECT sample_id, CASE WHEN na >= 0 THEN na END AS na, ca FROM numbers")
def null_negatives(spark, d):
    raw = raw_samples(spark, d)
    numbers = raw.select("sample_id", *[(clean_numeric(F.col(f"{c}_ugl")) / 1000.0 / MOLAR_MASS[IONS[c]]).alias(c) for c in ("na", "ca")])
    return m.null_negatives(numbers, ["na", "ca"])


_TDS = " + ".join(f"coalesce({c}, 0e0)" for c in IONS)


@register(f"SELECT sample_id, {r(_TDS, 9)} AS tds, {r(_TDS + ' + coalesce(ph, 0e0)', 9)} AS tds_o2 FROM samples")
def total_dissolved_solids(spark, d):
    species = {c: IONS[c] for c in IONS} | {"ph": "O2"}  # pH stands in for an O2 column
    df = m.total_dissolved_solids(samples(spark, d), columns=species, output="tds")
    df = m.total_dissolved_solids(df, include_o2=True, columns=species, output="tds_o2")
    return rounded(df.select("sample_id", "tds", "tds_o2"), "tds", "tds_o2", digits=9)


@register("SELECT sample_id, 'Basalt' AS rock_type, 7 AS database_number FROM samples")
def assign_constants(spark, d):
    return m.assign_constants(samples(spark, d).select("sample_id"), {"rock_type": "Basalt", "database_number": 7})


@register("""SELECT sample_id, CASE WHEN TRY_CAST(temperature_c AS DOUBLE) > 60 THEN 'Granite'
  WHEN TRY_CAST(temperature_c AS DOUBLE) <= 60 THEN 'Sandstone' END AS rock_type FROM raw""")
def classify_by_threshold(spark, d):
    return m.classify_by_threshold(raw_samples(spark, d), "temperature_c", 60.0, "Granite", "Sandstone", "rock_type").select(
        "sample_id", "rock_type")


_UNITS = {"mmol/L": 1.0, "µmol/L": 1000.0}


def _schema_rows() -> str:
    from ..schema import split_unit
    rows = []
    for a in TARGET_COLUMNS:
        name, unit = split_unit(a)
        mass = MOLAR_MASS.get(name) if unit in _UNITS else None
        n = f'(SELECT count("{a}") FROM long_names)' if a in _TARGET_SQL else "0::BIGINT"
        rows.append(f"SELECT '{a}' AS attribute, '{name}' AS simplified, '{unit}' AS unit, {f'{mass}e0' if mass else 'NULL::DOUBLE'} AS molar_mass, "
                    f"{f'{_UNITS[unit]}e0 / {mass}e0' if mass else 'NULL::DOUBLE'} AS factor, "
                    f"{f'{_UNITS[unit] * 1000.0}e0 / {mass}e0' if mass else 'NULL::DOUBLE'} AS factor_tabulated, {n} AS n_values")
    return " UNION ALL ".join(rows)


_LONG = "long_names AS (SELECT " + ", ".join(f'{c} AS "{t}"' for t, c in _TARGET_SQL.items()) + " FROM samples)"


@register(_schema_rows(), _LONG)
def schema_table(spark, d):
    counts = m.validate_schema(_long_names(spark, d)).select("attribute", "n_values")
    return counts.join(F.broadcast(schema_dimension(spark)), "attribute").drop("position")  # 31 rows


@register(" UNION ALL ".join(
    f"SELECT '{a}' AS attribute, {str(a in _TARGET_SQL).upper()} AS present, "
    + (f'(SELECT count("{a}") FROM long_names)' if a in _TARGET_SQL else "0::BIGINT") + " AS n_values" for a in TARGET_COLUMNS), _LONG)
def validate_schema(spark, d):
    return m.validate_schema(_long_names(spark, d))


@register('SELECT sample_id, "Na_in_mmol/L" AS "Na", "HCO3_in_mmol/L" AS "HCO3", "pH" FROM long_names', _LONG)
def select_by_pattern(spark, d):
    return tables.select_by_pattern(_long_names(spark, d), {"Na": r"^Na_in_", "HCO3": r"HCO3_in_", "pH": "pH", "Sr": r"^Sr_in_"},
                                    keep=["sample_id"])


_LABELS = list(DISPLAY_NAMES)


@register("SELECT feature, base, display_name, unit, n_values FROM (" + " UNION ALL ".join(
    f"""SELECT '{a}_log_gauss' AS feature, '{a}' AS base, '{DISPLAY_NAMES.get(a, a)}' AS display_name,
        '{a.split('_in_')[1] if '_in_' in a else ''}' AS unit, (SELECT count("{a}") FROM long_names) AS n_values"""
    for a in _TARGET_SQL if a not in ("sample_id", "location", "well_or_spring_name")) + ")", _LONG)
def label_features(spark, d):
    df = _long_names(spark, d).drop("sample_id", "location", "well_or_spring_name")
    counts = m.validate_schema(df, df.columns).select(F.concat("attribute", F.lit("_log_gauss")).alias("feature"), "n_values")
    return profile.label_features(counts)


@register("SELECT r.sample_id, r.location, r.well_or_spring_name, s.n_wells, t.first_id FROM raw r "
          "LEFT JOIN (SELECT well_or_spring_name, count(*) AS n_wells FROM raw WHERE ph IS NOT NULL GROUP BY 1) s USING (well_or_spring_name) "
          "LEFT JOIN (SELECT well_or_spring_name, min(sample_id) AS first_id FROM raw GROUP BY 1) t USING (well_or_spring_name)")
def join_sheets(spark, d):
    raw = raw_samples(spark, d)
    rock = raw.where("ph is not null").groupBy("well_or_spring_name").agg(F.count("*").alias("n_wells"))
    reservoir = raw.groupBy("well_or_spring_name").agg(F.min("sample_id").alias("first_id"))
    return joins.join_sheets(raw.select("sample_id", "location", "well_or_spring_name"), rock, reservoir)


@register("""SELECT a.sample_id, a.location, b.c_custkey FROM
  (SELECT *, row_number() OVER (ORDER BY sample_id) AS i FROM raw) a FULL JOIN
  (SELECT *, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) b ON a.i = b.i""")
def positional_concat(spark, d):
    left = raw_samples(spark, d).select("sample_id", "location")
    right = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey")
    return joins.positional_concat(left, right, "sample_id", "c_custkey")


_ROCKS = {"SS": "Sandstone", "granitic": "Granite", "chert or sandstone": "Chert", "Sandstone; Shale": "Shale"}


@register("SELECT sample_id, CASE lithology " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ROCKS.items())
          + " END AS rock_type, CASE CAST(ph AS INT) WHEN 5 THEN 'Limestone' WHEN 7 THEN 'Rhyolite' WHEN 8 THEN 'Andesite' END AS code_rock "
            "FROM (SELECT sample_id, lithology, trunc(ph) AS ph FROM raw)")
def map_category(spark, d):
    df = raw_samples(spark, d).select("sample_id", "lithology", F.col("ph").cast("int").alias("code"))
    df = categories.map_category(df, "lithology", _ROCKS, "rock_type")
    return categories.map_category(df, "code", {5: "Limestone", 7: "Rhyolite", 8: "Andesite"}, "code_rock").drop("lithology", "code")


_EXPANDED = {"sandstone; shale": ["Sandstone", "Shale"], "granitic": ["Granite"], "ss": ["Sandstone"]}


@register("SELECT sample_id, c AS rock_type FROM raw, (VALUES " + ", ".join(
    f"('{k}', '{c}')" for k, cs in _EXPANDED.items() for c in cs) + ") v(k, c) WHERE lower(trim(lithology)) = k "
    "UNION ALL SELECT sample_id, NULL FROM raw WHERE lithology IS NULL OR lower(trim(lithology)) NOT IN ('" + "', '".join(_EXPANDED) + "')")
def expand_category(spark, d):
    return categories.expand_category(raw_samples(spark, d).select("sample_id", "lithology"), "lithology", _EXPANDED, "rock_type").select(
        "sample_id", "rock_type")


_WORDS = ", ".join(f"('{w}', {'NULL' if c is None else repr(c)})" for w, cs in categories.LITHOLOGY_WORDS.items() for c in cs)
_KEYS = ", ".join(f"('{k}', '{c}')" for k, cs in categories.LITHOLOGY_KEYS.items() for c in cs)
_STOP = ", ".join(f"'{w}'" for w in categories.LITHOLOGY_STOP_WORDS)


@register("""SELECT sample_id, rock_type FROM (
  SELECT sample_id, NULL AS rock_type FROM keyed WHERE k IS NULL
  UNION ALL SELECT sample_id, keys.c FROM keyed JOIN keys USING (k)
  UNION ALL SELECT sample_id, CASE WHEN words.w IS NOT NULL THEN words.c ELSE upper(t[1]) || t[2:] END
  FROM tokens LEFT JOIN words ON t = words.w)""",
          rf"""keyed AS (SELECT sample_id, CASE WHEN lithology IS NULL OR lower(trim(lithology)) IN ('', 'nan') THEN NULL ELSE
  trim(regexp_replace(regexp_replace(replace(replace(replace(replace(lower(trim(lithology)), ';', ','), '&', ','), ' and ', ','), ' or ', ','),
  '\s+', ' ', 'g'), '\s*,\s*', ', ', 'g')) END AS k FROM raw),
words(w, c) AS (VALUES {_WORDS}), keys(k, c) AS (VALUES {_KEYS}),
tokens AS (SELECT * FROM (SELECT sample_id, trim(unnest(string_split(k, ','))) AS t FROM keyed
  WHERE k IS NOT NULL AND k NOT IN (SELECT k FROM keys)) WHERE t NOT IN ({_STOP}))""")
def expand_lithology(spark, d):
    return categories.expand_lithology(raw_samples(spark, d).select("sample_id", "lithology"), "lithology").select("sample_id", "rock_type")


_TIBET_IONS = {"na": "Na", "ca": "Ca", "mg": "Mg", "cl": "Cl", "so4": "SO4", "hco3": "HCO3"}


def _cell(c: str, s: str) -> str:
    return f"CASE WHEN {_NUM.format(c + '_ugl')} >= 0 THEN {_NUM.format(c + '_ugl')} / {MOLAR_MASS[s]}e0 END"


def _acquired_sql() -> str:
    fe = "TRY_CAST(replace(fe_ugl, '~', '') AS DOUBLE) / 1000e0 / 55.845e0"
    tds = " + ".join(f"coalesce({_cell(c, s)}, 0e0)" for c, s in _TIBET_IONS.items()) + f" + coalesce({fe}, 0e0)"
    source = {"location": "'Weixi–Qiaohou Fault'", "rock_type": "'Metamorphic Rock'", "pH": "ph",
              "temperature_in_c": "TRY_CAST(CASE WHEN contains(temperature_c, 'N/D') THEN NULL ELSE temperature_c END AS DOUBLE)",
              "WGS84_latitude": "latitude", "WGS84_longitude": "longitude", "Fe_in_mmol/L": fe, "Database_number": "database_number",
              "depth_bgl_in_m": "CAST(NULL AS DOUBLE)", "total_dissolved_solids_in_mmol/L": r(tds),
              **{f"{s}_in_mmol/L": _cell(c, s) for c, s in _TIBET_IONS.items()}}
    return f"SELECT sample_id, {_target_sql(source)} FROM raw"


def _vendor_sheet(raw):
    return raw.select(
        "sample_id", F.col("well_or_spring_name").alias(" Site"), F.col("latitude").alias("Latitude "), F.col("longitude").alias("LONGITUDE"),
        F.col("temperature_c").alias("Temperature  C"), F.col("ph").alias("pH"), F.col("database_number").alias("Database Number"),
        F.translate("fe_ugl", "~", "").alias("Fe_ugL"), *[F.col(f"{c}_ugl").alias(f"{s}_mgL") for c, s in _TIBET_IONS.items()],
        F.col("period").alias("Unmapped"))


@register(_acquired_sql())
def acquire_source_(spark, d):
    df = acquire_source(_vendor_sheet(raw_samples(spark, d)), SOURCES["MDPI_Tibet"], keep=["sample_id"])
    return rounded(df, "total_dissolved_solids_in_mmol/L")


_REFLECT_CLASSES = {"Pelite": "Claystone", "Psammite": "Sandstone", "Syenite": "Salt", "Greenschist": "Schist"}
_REFLECT_ROCK = "CASE sample_id % 5 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_REFLECT_CLASSES)) + " END"


def _reflect_sql() -> str:
    """Written from the published headers, classes and factors, not from the source's specification."""
    rock = "CASE sample_id % 5 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_REFLECT_CLASSES.values())) + " END"
    cell = lambda c, mass: f"CASE WHEN {_NUM.format(c)} >= 0 THEN {_NUM.format(c)} / {mass}e0 END"
    source = {"location": "location", "well_or_spring_name": "well_or_spring_name", "WGS84_latitude": "latitude", "WGS84_longitude": "longitude",
              "rock_type": rock, "stratigraphic_period": "period", "pH": "ph", "Na_in_mmol/L": cell("na_ugl", 22.989769),
              "Ca_in_mmol/L": cell("ca_ugl", 40.078)}
    names = ", ".join(f'{v} AS "{k}"' for k, v in source.items())
    return f"SELECT sample_id, {names} FROM raw"


@register(_reflect_sql())
def acquire_reflect(spark, d):
    """Three sheets: wells and analyses, rocks, reservoirs; the later two carry no well name and are joined by position."""
    raw = raw_samples(spark, d)
    wells = raw.select("sample_id", F.col("location").alias("NUTS2_Name"), F.col("well_or_spring_name").alias("Local_ID_F"),
                       F.col("latitude").alias("Latitude_"), F.col("longitude").alias("Longitude_"), F.col("ph").alias("pH"),
                       F.col("na_ugl").alias("Na_mg_per_l"), F.col("ca_ugl").alias("Ca_mg_per_l"))
    rocks = raw.select("sample_id", F.expr(_REFLECT_ROCK).alias("Rock Type"))
    reservoirs = raw.select("sample_id", F.col("period").alias("Age of Formation"))
    done = acquire_source(wells, SOURCES["REFLECT"], keep=["sample_id"], sheets=[rocks, reservoirs], order="sample_id")
    return done.select("sample_id", "location", "well_or_spring_name", "WGS84_latitude", "WGS84_longitude", "rock_type",
                       "stratigraphic_period", "pH", q("Na_in_mmol/L"), q("Ca_in_mmol/L"))


@register("""SELECT 'Sample_' || CAST(database_number AS STRING) AS "Database_name", sample_id, na FROM samples""")
def union_sources_(spark, d):
    df = samples(spark, d).select("sample_id", "na", "database_number")
    parts = {f"Sample_{i}": df.where(F.col("database_number") == i).drop("database_number") for i in range(1, 14)}
    return union_sources(parts)


@register("""SELECT database_name, count(*) AS n_part, count(*) AS n_merged, TRUE AS matches FROM samples GROUP BY 1""")
def merge_reconciliation_(spark, d):
    df = samples(spark, d).select("sample_id", "database_name")
    path = tables.write_snapshot(df, workspace(spark, "merged"), "now")
    return merge_reconciliation(df, spark.read.parquet(path), "database_name")


@register("SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS original_row, na FROM samples")
def original_row_number(spark, d):
    return global_row_number(samples(spark, d).select("sample_id", "na"), "sample_id", output="original_row")


@register("SELECT sample_id, ph AS ph_hooked, 'conformed' AS stage FROM raw WHERE ph IS NOT NULL")
def source_hooks(spark, d):
    from ..plans.acquire import run_hooks
    raw = raw_samples(spark, d).select(F.col("sample_id").alias("Sample ID"), F.col("ph").alias("PH Hooked"))
    before = [lambda df: df.where(q("PH Hooked").isNotNull())]
    after = [lambda df: df.withColumn("stage", F.lit("conformed"))]
    return run_hooks(m.conform_headers(run_hooks(raw, before)), after)


@register(f"""SELECT sample_id, {_NUM.format('fe_ugl')} / 79.904e0 * 1000e0 AS "Br_in_umol/L" FROM raw""")
def configurable_schema(spark, d):
    raw = raw_samples(spark, d).select("sample_id", clean_numeric(F.col("fe_ugl")).alias("Br_in_mg/L"))
    return m.convert_units_by_name(raw, {**MOLAR_MASS, "Br": 79.904}, ["Br_in_umol/L"]).drop("Br_in_mg/L")


@register("SELECT 'x' AS run_id, count(*) AS n_samples, " + ", ".join(f"{r(f'avg({c})')} AS {c}" for c in BASE) + " FROM samples")
def run_metadata(spark, d):
    root = workspace(spark, "models")
    df = samples(spark, d)
    document = df.agg(
        F.lit("x").alias("run_id"), F.lit(3).alias("run_index"), F.count("*").alias("n_samples"),
        F.array(*[F.avg(c) for c in BASE]).alias("mean"))
    tables.write_run_metadata(document, root)
    read = tables.read_run_metadata(spark, root, 3)
    means = read.select("run_id", "n_samples", *[F.get("mean", F.lit(i)).alias(c) for i, c in enumerate(BASE)])
    return rounded(means, *BASE)
