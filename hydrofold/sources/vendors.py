"""The thirteen published sources: header mappings, constants, factors and rock vocabularies.

Everything here is fixed data. Ion columns follow one header pattern per source, so a mapping is the
pattern applied to the species the source reports, plus its named columns.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.categories import expand_category, expand_lithology, map_category
from ..operators.mapping import classify_by_threshold
from ..schema import species_column

MAJOR = ("Na", "Mg", "Ca", "Cl", "SO4", "HCO3")


def ions(pattern: str, *species: str) -> dict[str, str]:
    """Header to target column for species named by a pattern, ``{}_mgl`` say."""
    return {pattern.format(s.lower()): species_column(s) for s in species}


def well(location: str | None, name: str, latitude: str, longitude: str, **more: str) -> dict[str, str]:
    """Header to target column for place and field measurements; keywords name the target."""
    targets = {
        "depth": "depth_bgl_in_m", "rock": "rock_type", "period": "stratigraphic_period", "temperature": "temperature_in_c",
        "conductivity": "electrical_conductivity_25c_in_uS/cm", "redox": "redox_potential_in_mV", "ph": "pH",
        "number": "Database_number",
    }
    named = {location: "location"} if location else {}
    named |= {name: "well_or_spring_name", latitude: "WGS84_latitude", longitude: "WGS84_longitude"}
    return named | {header: targets[k] for k, header in {"number": "database_number", **more}.items()}


@dataclass(frozen=True)
class SourceSpec:
    """How one source becomes sample rows."""

    name: str
    mapping: Mapping[str, str]
    constants: Mapping[str, object] = field(default_factory=dict)
    multiply: Mapping[str, float] = field(default_factory=dict)
    divide: Mapping[str, float] = field(default_factory=dict)
    rock: Callable[[DataFrame], DataFrame] | None = None
    include_o2: bool = False
    molar_mass: Mapping[str, float] = field(default_factory=dict)
    sheets: tuple[Mapping[str, str], ...] = ()


# --- fixed values: rock classes of the REFLECT sheets ---
REFLECT_ROCKS = {
    "Pelite": "Claystone", "Micritic limestone": "Limestone", "Psammite": "Sandstone", "Sparitic limestone": "Limestone",
    "Chert": "Chert", "Breccia": "Breccia", "Carbonatic siliciclastic rock": "Sandstone", "Gneiss": "Gneiss",
    "Granite": "Granite", "Dolomite": "Dolomite", "Andesite": "Andesite", "Syenite": "Salt",
    "Rhyolitic volcaniclast": "Rhyolite", "Andesitic volcaniclast": "Andesite", "Basalt": "Basalt",
    "sand and gravel": "Sand and Gravel", "Amphibolite": "Amphibolite", "Quartzite": "Quartzite", "Schist": "Schist",
    "Greenschist": "Schist", "Marble": "Marble", "limestone": "Limestone",
}
# --- fixed values: rock codes of the Alps source; 2 and 10 are left out on purpose ---
ALPS_ROCKS = {
    1: "Sand and Gravel", 3: "Rhyolite", 4: "Breccia", 5: "Limestone", 6: "Gypsum", 7: "Rhyolite", 8: "Andesite",
    9: "Basalt", 11: "Salt",
}
# --- fixed values: rock lists of the Hessen source, one sample row per class ---
HESSEN_ROCKS = {
    "quartzite": ["Quartzite"],
    "sandstone": ["Sandstone"],
    "unconsolidated rocks": ["Sand and Gravel"],
    "arkose, sandstone, conglomerate": ["Sandstone"],
    "pelite": ["Claystone"],
    "slate, sandstone": ["Slate", "Sandstone"],
    "dolomite": ["Dolomite"],
    "greenschist": ["Schist"],
    "gneiss, greenschist": ["Gneiss", "Greenschist"],
    "pelite, halite rock": ["Claystone", "Salt"],
    "sandstone, limestone, granite": ["Sandstone", "Limestone", "Granite"],
    "unconsolidated rocks, carbonate bearing silt": ["Sand and Gravel"],
    "limestone": ["Limestone"],
    "slate": ["Slate"],
    "phyllite": ["Phyllite"],
    "marl": ["Marl"],
    "pelite, sandstone, conglomerate": ["Sandstone", "Claystone"],
    "chert": ["Chert"],
    "graywacke, dolerite": ["Dolerite"],
    "gypsum": ["Gypsum"],
    "dolomite, pelite": ["Dolomite", "Claystone"],
    "graywacke, slate": ["Slate"],
    "unconsolidated rocks, marl": ["Marl", "Sand and Gravel"],
    "quartzite, slate": ["Quartzite", "Slate"],
    "pelite, sandstone": ["Claystone", "Sandstone"],
    "slate, pelite": ["Slate", "Claystone"],
    "dolerite": ["Dolerite"],
    "tuff, hawaiite": ["Tuff"],
    "muscovite‑biotite‑gneiss": ["Gneiss"],
    "dolomite, pelite, limestone, anhydrite": ["Dolomite", "Claystone", "Limestone"],
    "marl, pelite, limestone": ["Marl", "Claystone", "Limestone"],
    "arkose": ["Sandstone"],
    "limestone, arkose, pelite": ["Limestone", "Sandstone", "Claystone"],
    "slate, volcanic rocks": ["Slate"],
    "slate, graywacke": ["Slate", "Graywacke"],
    "marl, dolomite": ["Marl", "Dolomite"],
    "slate, graywacke, dolerite": ["Slate", "Graywacke", "Dolerite"],
    "gneiss, phyllite": ["Gneiss", "Phyllite"],
}
ROCK = "rock_type"
FEET = 0.3048

# Second and third sheet of the REFLECT workbook; neither maps the join key.
REFLECT_ROCK_SHEET = {"rock_type": ROCK}
REFLECT_RESERVOIR_SHEET = {"age_of_formation": "stratigraphic_period"}

# --- fixed values: the sources' headers, constants and factors ---
SOURCES = {
    spec.name: spec
    for spec in (
        SourceSpec(
            "REFLECT",
            well("nuts2_name", "local_id_f", "latitude_", "longitude_", depth="well_depth_m", temperature="temperature_c",
                 conductivity="electrical_conductivity_us_per_cm_ec25", ph="ph", redox="eh_mv")
            | {"dissolved_oxigen_mg_per_l": species_column("O2")}
            | ions("{}_mg_per_l", *MAJOR, "Li", "K", "Sr", "Fe", "Mn", "F"),
            rock=lambda df: map_category(df, ROCK, REFLECT_ROCKS) if ROCK in df.columns else df,
            molar_mass={"O2": 31.998}, sheets=(REFLECT_ROCK_SHEET, REFLECT_RESERVOIR_SHEET),
        ),
        SourceSpec(
            "MDPI_Tibet",
            well(None, "site", "latitude", "longitude", temperature="temperature_c", conductivity="conductivity_us_cm", ph="ph")
            | ions("{}_mgl", *MAJOR, "K", "F", "NO3") | ions("{}_ugl", "Li", "Sr", "Fe", "Mn"),
            constants={ROCK: "Metamorphic Rock", "location": "Weixi–Qiaohou Fault"},
            divide={species_column(s): 1000.0 for s in ("Li", "Sr", "Fe", "Mn")},
        ),
        SourceSpec(
            "CAES2014",
            well("county", "samplingfeaturename", "latdegree", "longdegree", depth="drilleddepth_ft",
                 temperature="fluidtemperature_c", ph="ph_field")
            | ions("{}_mgl", "Na", "Mg", "Ca", "Cl", "SO4", "Li", "K", "Sr", "F") | {"alkalinity_mgl": species_column("HCO3")},
            constants={ROCK: "Basalt"}, multiply={"depth_bgl_in_m": FEET},
        ),
        SourceSpec(
            "ALPS",
            well("spring_location", "spring_name", "latitude", "longitude", depth="well_depth_m", rock="lithology",
                 temperature="temperature_degr_c", conductivity="ec_s_m-1", ph="ph")
            | ions("{}_mg_l-1", *MAJOR, "Li", "K", "NH4", "F", "NO3"),
            multiply={"electrical_conductivity_25c_in_uS/cm": 100.0},
            rock=lambda df: map_category(df, ROCK, ALPS_ROCKS) if ROCK in df.columns else df,
        ),
        SourceSpec(
            "YUKON",
            well("location", "name", "latitude_dd", "longitude_dd", conductivity="conductivity", temperature="water_temp", ph="ph")
            | ions("{}_mg_l", *MAJOR, "K", "F"),
            constants={ROCK: "Granite"},
        ),
        SourceSpec(
            "SVZ-CHILE",
            well("location_name", "fault_domain", "wgs84_latitude", "wgs84_longitude", temperature="t_c", ph="ph")
            | ions("{}_ppm", *MAJOR, "Li", "K") | ions("{}_ppb", "Sr"),
            constants={ROCK: "Andesite"}, divide={species_column("Li"): 1000.0},
        ),
        SourceSpec(
            "GANDAKI",
            well("location", "id", "wgs84_latitude", "wgs84_longitude", temperature="temp_c", conductivity="ec_us_cm", ph="ph")
            | ions("{}_mg_l", *MAJOR, "K", "Fe", "F", "NO3"),
            constants={ROCK: "Metamorphic Rock"},
        ),
        SourceSpec(
            "HESSEN",
            well("town", "well_or_spring_name", "coordinates_r", "coordinates_h", depth="final_depth", rock="rock_type",
                 period="period", temperature="temperature", conductivity="electric", ph="ph", redox="redox")
            | {word: species_column(s) for word, s in (
                ("oxigen", "O2"), ("sodium", "Na"), ("magnesium", "Mg"), ("calcium", "Ca"), ("chloride", "Cl"),
                ("sulphate", "SO4"), ("bicarbonate", "HCO3"), ("lithium", "Li"), ("potassium", "K"), ("strontium", "Sr"),
                ("ammonium", "NH4"), ("iron", "Fe"), ("manganese", "Mn"), ("fluoride", "F"), ("nitrate", "NO3"),
                ("silica", "H2SiO3"))},
            rock=lambda df: expand_category(df, ROCK, HESSEN_ROCKS) if ROCK in df.columns else df,
        ),
        SourceSpec(
            "XIANSHUIHE",
            well(None, "no", "wgs84_latitude", "wgs84_longitude", temperature="temperature", conductivity="ec", ph="ph")
            | ions("{}", *MAJOR, "K"),
            constants={ROCK: "Metamorphic Rock"},
        ),
        SourceSpec(
            "AUSTRALIA-MATARANKA",
            well("cla_flow_path", "bore_spring", "latitude", "longitude")
            | ions("{}_mg-l", "Na", "Mg", "Ca", "Cl", "SO4", "K") | {"alkalinity_meq-l": species_column("HCO3")},
            constants={ROCK: "Limestone"}, multiply={species_column("HCO3"): 61.0168},
        ),
        SourceSpec(
            "THAILAND",
            well("geothermal_province", "hot_spring", "latitude", "longitude", ph="ph", temperature="surface_temperature")
            | ions("{}_mg-l", *MAJOR, "K", "Fe", "Mn"),
            rock=lambda df: classify_by_threshold(df, "temperature_in_c", 60.0, "Granite", "Sandstone", ROCK)
            if "temperature_in_c" in df.columns else df,
        ),
        SourceSpec(
            "ARGONNE",
            well("state", "name", "latitude", "longitude", depth="depth_ft", temperature="temperature_c", ph="ph")
            | ions("{}", *MAJOR, "Li", "K", "Sr", "Fe", "Mn", "F") | ions("{}_n", "NH4", "NO3"),
            multiply={"depth_bgl_in_m": FEET},
        ),
        SourceSpec(
            "USGS",
            well("county", "wellname", "latitude", "longitude", depth="depthlower", period="period", temperature="temp", ph="ph")
            | {"lithology": "temporary_lithology", "fetot": species_column("Fe")}
            | ions("{}", *MAJOR, "Li", "K", "Sr", "NH4", "Mn", "F", "NO3", "HS"),
            rock=lambda df: expand_lithology(df, "temporary_lithology", ROCK).drop("temporary_lithology")
            if "temporary_lithology" in df.columns else df,
        ),
    )
}
