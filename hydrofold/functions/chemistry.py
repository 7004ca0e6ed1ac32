"""Concentration units and the ionic charge balance as column expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import ANIONS, BALANCE_MASS, CATIONS, VALENCE, q
from .cleaning import numeric


def to_millimolar(mg_per_l: Column, molar_mass: float) -> Column:
    """mg/L to mmol/L."""
    return mg_per_l / F.lit(molar_mass)


def to_micromolar(mg_per_l: Column, molar_mass: float) -> Column:
    """mg/L to µmol/L."""
    return to_millimolar(mg_per_l, molar_mass) * F.lit(1000.0)


def total(columns: list[Column]) -> Column:
    """Row sum where a missing value counts as zero."""
    return reduce(add, [F.coalesce(c, F.lit(0.0)) for c in columns], F.lit(0.0))


# fixed values: least sum of equivalents for which a variant defines the error
MIN_EQUIVALENTS = {"standard": 1e-9, "strict": 1e-4, "plain": 0.1}


def find_ion_columns(columns: list[str]) -> dict[str, tuple[str, str]]:
    """{ion: (column, unit)} for the first column of each balance ion named ``<ion>_in_<unit>``."""
    found = {}
    for ion in VALENCE:
        for name in columns:
            match = re.search(ion + r"_in_([a-zA-Z0-9/]+)", name)
            if match:
                found[ion] = (name, match.group(1))
                break
    return found


def _equivalents(column: Column, unit: str, ion: str, variant: str) -> Column:
    """meq/L of one ion under a variant's unit rules.

    Standard converts mg and µmol and takes anything else as mmol/L. Strict also knows equivalents and ppm,
    and an unknown unit contributes nothing. Plain takes every column as mmol/L.
    """
    value, charge, mass = F.coalesce(column, F.lit(0.0)), float(VALENCE[ion]), BALANCE_MASS[ion]
    unit = unit.lower()
    if variant == "strict":
        return value * F.lit({"mmol/l": charge, "mg/l": charge / mass, "ppm": charge / mass, "meq/l": 1.0}.get(unit, 0.0))
    if variant == "standard" and unit in ("mg/l", "mg_l"):
        return value / F.lit(mass) * F.lit(charge)
    if variant == "standard" and unit in ("umol/l", "umol_l"):
        return value / F.lit(1000.0) * F.lit(charge)
    return value * F.lit(charge)


def ionic_balance(df: DataFrame, ions: dict[str, tuple[str, str]] | None = None, variant: str = "standard",
                  numeric_input: bool = True, require_all: bool = False) -> Column:
    """Charge balance error in percent, null where it is undefined.

    ``ions`` maps each ion to (column, unit); by default they are found by name. A missing ion counts as
    zero; a missing ion *column* makes every row undefined in the standard variant. ``require_all`` also
    undefines rows that lack an ion.
    """
    ions = ions or find_ion_columns(df.columns)
    if variant == "standard" and len(ions) < len(VALENCE):
        return F.lit(None).cast("double")

    def side(names) -> Column:
        cells = [(_equivalents(q(c) if numeric_input else numeric(q(c)), unit, ion, variant))
                 for ion in names if ion in ions for c, unit in [ions[ion]]]
        return reduce(add, cells, F.lit(0.0))

    cations, anions = side(CATIONS), side(ANIONS)
    enough = cations + anions
    threshold = F.lit(MIN_EQUIVALENTS[variant])
    defined = enough >= threshold if variant == "standard" else enough > threshold
    if require_all:
        defined = defined & reduce(lambda a, b: a & b, [q(c).isNotNull() for c, _ in ions.values()])
    return F.when(defined, (cations - anions) / enough * F.lit(100.0))
