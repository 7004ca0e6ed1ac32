"""From differently headed source tables to the target schema."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.chemistry import to_micromolar, to_millimolar, total
from ..functions.cleaning import apply_to_text, clean_numeric, conform_name, parse_numbers, text_columns, unify_null
from ..schema import CHEMISTRY, MICROMOLAR, MOLAR_MASS, TARGET_TYPES, q, species_column

# fixed value: a misspelling that several sources share
HEADER_ALIASES = {"dissolved_oxygen_mg_per_l": "dissolved_oxigen_mg_per_l"}


def conform_headers(df: DataFrame, aliases: Mapping[str, str] = HEADER_ALIASES) -> DataFrame:
    """Headers trimmed, lower-cased, white space as ``_``; of equal names the first column stays.

    An alias applies only where its target is absent. Columns are addressed by position, because the
    raw headers may repeat.
    """
    names = [conform_name(c) for c in df.columns]
    names = [aliases[n] if n in aliases and aliases[n] not in names else n for n in names]
    positional = [f"_{i}" for i in range(len(names))]
    first = {}
    for place, name in zip(positional, names):
        first.setdefault(name, place)
    return df.toDF(*positional).select([F.col(place).alias(name) for name, place in first.items()])


def apply_mapping(df: DataFrame, mapping: Mapping[str, str], keep: Iterable[str] = ()) -> DataFrame:
    """Rename the mapped columns that exist and drop the rest; ``keep`` names columns to carry along."""
    known = {conform_name(source): target for source, target in mapping.items()}
    kept = [q(c) for c in keep if c in df.columns]
    return df.select(kept + [q(source).alias(target) for source, target in known.items() if source in df.columns])


def missing_mapping_keys(df: DataFrame, mapping: Mapping[str, str]) -> list[str]:
    """Mapping keys without a column in ``df``."""
    return sorted({conform_name(k) for k in mapping} - set(df.columns))


def mapping_report(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """One row per mapping key: target, whether the source has it, and how many values it brings."""
    known = {conform_name(source): target for source, target in mapping.items()}
    rows = [
        F.struct(F.lit(source).alias("source"), F.lit(target).alias("target"),
                 F.lit(source in df.columns).alias("present"),
                 (F.count(q(source)) if source in df.columns else F.lit(0).cast("long")).alias("n_values"))
        for source, target in known.items()
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def read_and_map(df: DataFrame | None, mapping: Mapping[str, str], keep: Iterable[str] = ()) -> DataFrame | None:
    """Headers conformed, then mapped; None for an absent sheet or when nothing maps."""
    if df is None:
        return None
    mapped = apply_mapping(conform_headers(df), mapping, keep)
    return mapped if set(mapped.columns) - set(keep) else None


def complete_schema(df: DataFrame, target: Mapping[str, T.DataType] = TARGET_TYPES, keep: Iterable[str] = ()) -> DataFrame:
    """Target columns in order, absent ones as null; ``keep`` columns lead."""
    cells = [q(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in target.items()]
    return df.select([q(c) for c in keep if c in df.columns] + cells)


def unify_nulls(df: DataFrame) -> DataFrame:
    """Blank text cells and those holding ``N/D`` become null."""
    return apply_to_text(df, text_columns(df), unify_null)


def prescale(df: DataFrame, factors: Mapping[str, float], divide: bool = False) -> DataFrame:
    """Source-specific factors applied to strictly numeric cells before unit conversion."""
    present = {c: f for c, f in factors.items() if c in df.columns}
    parsed = parse_numbers(df, present)
    return parsed.withColumns({c: q(c) / F.lit(f) if divide else q(c) * F.lit(f) for c, f in present.items()}) if present else df


def convert_units(df: DataFrame, molar_mass: Mapping[str, float] = MOLAR_MASS) -> DataFrame:
    """Species columns hold mg/L under their target name; turn them into the unit the name says."""
    present = {c: s for c, s in CHEMISTRY.items() if c in df.columns}
    converted = {c: (to_micromolar if s in MICROMOLAR else to_millimolar)(q(c), molar_mass[s]) for c, s in present.items()}
    return parse_numbers(df, present, clean_numeric).withColumns(converted) if present else df


def convert_units_by_name(df: DataFrame, molar_mass: Mapping[str, float] = MOLAR_MASS,
                          attributes: Iterable[str] = tuple(TARGET_TYPES)) -> DataFrame:
    """Add ``X_in_mmol/L`` or ``X_in_umol/L`` for every ``X_in_mg/L`` the schema knows; others stay as they are."""
    attributes, cells = set(attributes), {}
    for name in df.columns:
        if "_in_mg/L" not in name and "_in_mg_L" not in name:
            continue
        species = name.replace("_in_mg/L", "").replace("_in_mg_L", "")
        if species not in molar_mass:
            continue
        for unit, convert in (("mmol/L", to_millimolar), ("umol/L", to_micromolar)):
            if species_column(species, unit) in attributes:
                cells[species_column(species, unit)] = name, convert, molar_mass[species]
                break
    parsed = parse_numbers(df.withColumns({c: q(name) for c, (name, _, _) in cells.items()}), cells) if cells else df
    return parsed.withColumns({c: convert(q(c), mass) for c, (_, convert, mass) in cells.items()}) if cells else df


def null_negatives(df: DataFrame, columns: Iterable[str] = tuple(CHEMISTRY)) -> DataFrame:
    """Negative concentrations become null."""
    cells = {c: F.when(q(c) >= 0, q(c)) for c in columns if c in df.columns}
    return df.withColumns(cells) if cells else df


def total_dissolved_solids(df: DataFrame, include_o2: bool = False, columns: Mapping[str, str] | None = None,
                           output: str = "total_dissolved_solids_in_mmol/L") -> DataFrame:
    """Sum of the species in mmol/L, missing ones as zero; ``columns`` maps column to species."""
    columns = {c: s for c, s in (columns or CHEMISTRY).items() if c in df.columns}
    milli = [q(c) for c, s in columns.items() if s not in MICROMOLAR and (include_o2 or s != "O2")]
    micro = [q(c) for c, s in columns.items() if s in MICROMOLAR]
    return df.withColumn(output, total(milli) + total(micro) / F.lit(1000.0))


def assign_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Constant columns of a source."""
    return df.withColumns({c: F.lit(v) for c, v in values.items()}) if values else df


def classify_by_threshold(df: DataFrame, column: str, threshold: float, above: str, otherwise: str, output: str) -> DataFrame:
    """Class by a numeric threshold, null where the value is missing; overwrites ``output``."""
    value = parse_numbers(df.withColumn("_v", q(column)), ["_v"])
    return value.withColumn(
        output, F.when(F.col("_v") > threshold, above).when(F.col("_v") <= threshold, otherwise)
    ).drop("_v")


def validate_schema(df: DataFrame, target: Iterable[str] = tuple(TARGET_TYPES)) -> DataFrame:
    """One row per target attribute: present or not, and its number of values."""
    rows = [
        F.struct(F.lit(a).alias("attribute"), F.lit(a in df.columns).alias("present"),
                 (F.count(q(a)) if a in df.columns else F.lit(0).cast("long")).alias("n_values"))
        for a in target
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
