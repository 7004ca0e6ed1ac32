"""The sample model: one wide row per water sample, units carried in the column name.

Fixed values (molar masses, valences, column order, feature pools) are data that must equal the
published model for results to agree; everything else in the package is derived from them.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# --- fixed values: species with their molar mass in g/mol, and the unit each is stored in ---
MOLAR_MASS = {
    "O2": 31.9988, "Na": 22.989769, "Mg": 24.305, "Ca": 40.078, "Cl": 35.45, "SO4": 96.06,
    "HCO3": 61.0168, "Li": 6.94, "K": 39.0983, "Sr": 87.62, "NH4": 18.038, "Fe": 55.845,
    "Mn": 54.938, "F": 18.998, "NO3": 62.0049, "H2SiO3": 78.11, "HS": 33.07,
}
MICROMOLAR = ("Sr", "NH4", "F", "H2SiO3")

# --- fixed values: charge balance uses rounded masses ---
BALANCE_MASS = {"Na": 22.99, "Ca": 40.08, "Mg": 24.31, "Cl": 35.45, "HCO3": 61.02, "SO4": 96.06}
VALENCE = {"Na": 1, "Ca": 2, "Mg": 2, "Cl": 1, "HCO3": 1, "SO4": 2}
CATIONS = ("Na", "Ca", "Mg")
ANIONS = ("Cl", "HCO3", "SO4")

# --- fixed values: unit suffixes in matching order ---
UNIT_SUFFIXES = (
    ("_in_mmol/L", "mmol/L"), ("_in_umol/L", "µmol/L"), ("_in_mV", "mV"),
    ("_in_m", "m"), ("_in_c", "°C"), ("_in_uS/cm", "µS/cm"),
)

# --- fixed values: features every model uses, and the pool it may be extended from ---
BASE_FEATURES = ("Na_in_mmol/L", "Mg_in_mmol/L", "Ca_in_mmol/L", "Cl_in_mmol/L", "SO4_in_mmol/L", "HCO3_in_mmol/L")
OPTIONAL_FEATURES = (
    "temperature_in_c", "pH", "electrical_conductivity_25c_in_uS/cm", "redox_potential_in_mV",
    "K_in_mmol/L", "NO3_in_mmol/L", "Li_in_mmol/L", "Fe_in_mmol/L", "Mn_in_mmol/L", "HS_in_mmol/L",
    "O2_in_mmol/L", "Sr_in_umol/L", "NH4_in_umol/L", "F_in_umol/L", "H2SiO3_in_umol/L", "depth_bgl_in_m",
)
PINNED_LABELS = ("Base_without_pH", "Base_with_pH", "Plus_pH-Fe", "Plus_pH-K-Fe", "Plus_pH-K-Fe-Mn", "Plus_temperature")

# --- fixed values: German display names of features in result tables ---
DISPLAY_NAMES = {
    "Na_in_mmol/L": "Natrium", "Mg_in_mmol/L": "Magnesium", "Ca_in_mmol/L": "Calcium", "Cl_in_mmol/L": "Chlorid",
    "SO4_in_mmol/L": "Sulfat", "HCO3_in_mmol/L": "Hydrogencarbonat", "Fe_in_mmol/L": "Eisen",
    "K_in_mmol/L": "Kalium", "Mn_in_mmol/L": "Mangan", "pH": "pH-Wert", "temperature_in_c": "Temperatur",
}


def species_column(species: str, unit: str | None = None) -> str:
    """Column holding a species: ``Na_in_mmol/L``, ``Sr_in_umol/L``."""
    unit = unit or ("umol/L" if species in MICROMOLAR else "mmol/L")
    return f"{species}_in_{unit}"


# --- fixed values: order of the 31 target columns ---
TARGET_TYPES: dict[str, T.DataType] = {
    "location": T.StringType(),
    "well_or_spring_name": T.StringType(),
    "WGS84_latitude": T.DoubleType(),
    "WGS84_longitude": T.DoubleType(),
    "depth_bgl_in_m": T.DoubleType(),
    "rock_type": T.StringType(),
    "stratigraphic_period": T.StringType(),
    "temperature_in_c": T.DoubleType(),
    "electrical_conductivity_25c_in_uS/cm": T.DoubleType(),
    "pH": T.DoubleType(),
    "redox_potential_in_mV": T.DoubleType(),
    "total_dissolved_solids_in_mmol/L": T.DoubleType(),
    **{
        species_column(s): T.DoubleType()
        for s in ("O2", "Na", "Mg", "Ca", "Cl", "SO4", "HCO3", "Li", "K", "Sr", "NH4", "Fe", "Mn", "F", "NO3", "H2SiO3", "HS")
    },
    "Database_number": T.IntegerType(),
    "Database_name": T.StringType(),
}
TARGET_COLUMNS = tuple(TARGET_TYPES)
CHEMISTRY = {species_column(s): s for s in MOLAR_MASS}


def sample_schema(with_key: bool = False) -> T.StructType:
    """Read schema of the consolidated sample table; ``with_key`` puts ``sample_id`` first."""
    fields = [T.StructField("sample_id", T.LongType())] if with_key else []
    return T.StructType(fields + [T.StructField(n, t) for n, t in TARGET_TYPES.items()])


def q(name: str) -> Column:
    """Column by its literal name; the schema's names hold ``/``."""
    return F.col("`" + name.replace("`", "``") + "`")


def split_unit(attribute: str) -> tuple[str, str]:
    """(simplified name, unit) by the first suffix that occurs in the attribute name."""
    for suffix, unit in UNIT_SUFFIXES:
        if suffix in attribute:
            return attribute.replace(suffix, ""), unit
    return attribute, ""


def schema_table(spark: SparkSession, attributes=TARGET_COLUMNS, molar_mass=MOLAR_MASS) -> DataFrame:
    """Attribute dimension: simplified name, unit, molar mass and the two mg/L factors.

    ``factor`` turns mg/L into the target unit; ``factor_tabulated`` is the published table's value,
    a thousand times larger. New substances only need entries in the two arguments.
    """
    rows = []
    for position, attribute in enumerate(attributes):
        name, unit = split_unit(attribute)
        mass = molar_mass.get(name) if unit in ("mmol/L", "µmol/L") else None
        scale = 1000.0 if unit == "µmol/L" else 1.0
        rows.append((position, attribute, name, unit, mass,
                     scale / mass if mass else None, scale * 1000.0 / mass if mass else None))
    return spark.createDataFrame(
        rows,
        "position int, attribute string, simplified string, unit string, molar_mass double, "
        "factor double, factor_tabulated double",
    )


def feature_label(extra) -> str:
    """Name of the feature set that adds ``extra`` to the base features."""
    if not extra:
        return "Base_without_pH"
    label = "Plus_" + "-".join(f.split("_in_")[0] for f in extra)
    return "Base_with_pH" if label == "Plus_pH" else label


def feature_sets(pool=OPTIONAL_FEATURES, max_extra: int = 3, manual=(("pH", "K_in_mmol/L", "Fe_in_mmol/L", "Mn_in_mmol/L"),)):
    """(label, extra features) for the base, every combination of at most ``max_extra``, and manual sets."""
    sets = [()] + [c for r in range(1, max_extra + 1) for c in combinations(pool, r)] + [tuple(m) for m in manual]
    return [(feature_label(s), s) for s in sets]
