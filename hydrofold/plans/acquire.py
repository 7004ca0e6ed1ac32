"""Source table to sample rows, and thirteen sources to one table."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.cleaning import parse_numbers
from ..operators import mapping as m
from ..operators.joins import join_sheets, positional_concat
from ..schema import CHEMISTRY, MOLAR_MASS, TARGET_TYPES, q
from ..sources.vendors import SourceSpec

Hook = Callable[[DataFrame], DataFrame]


def run_hooks(df: DataFrame, hooks: Iterable[Hook]) -> DataFrame:
    """User callables applied in order; a failing one is named in the error."""
    for hook in hooks:
        try:
            df = df.transform(hook)
        except Exception as error:
            raise ValueError(f"source hook {getattr(hook, '__name__', hook)!r} failed: {error}") from error
    return df


def acquire_source(df: DataFrame, spec: SourceSpec, keep: Iterable[str] = (), before: Iterable[Hook] = (),
                   after: Iterable[Hook] = (), sheets: Iterable[DataFrame] = (), order: str | None = None) -> DataFrame:
    """Sample rows of one source.

    ``before`` hooks see the raw table, ``after`` hooks the conformed one. ``keep`` carries key columns
    through, so rows a rock list duplicates stay countable. ``sheets`` are the source's further sheets in the order of
    ``spec.sheets``; they are joined on the well name, or by position in the column ``order`` that every sheet has.
    """
    keep = list(keep)
    conformed = run_hooks(m.conform_headers(run_hooks(df, before)), after)
    carried = [*keep, *([order] if order and order not in keep else [])]
    mapped = m.apply_mapping(conformed, spec.mapping, carried)
    for sheet, mapping in zip(sheets, spec.sheets):
        other = m.apply_mapping(m.conform_headers(sheet), mapping, [order] if order else [])
        if "well_or_spring_name" in mapped.columns and "well_or_spring_name" in other.columns:
            mapped = join_sheets(mapped, other.drop(order) if order else other)
        elif order is None:
            raise ValueError(f"a sheet of {spec.name!r} has no well name; name the column that orders the sheets")
        else:
            mapped = positional_concat(mapped, other, order, order)
    return harmonise(mapped.drop(order) if order and order not in keep else mapped, spec, keep)


def harmonise(mapped: DataFrame, spec: SourceSpec, keep: Iterable[str] = ()) -> DataFrame:
    """Mapped source columns to the target schema: rock class, nulls, factors, units, dissolved solids."""
    classified = spec.rock(mapped) if spec.rock else mapped
    unified = m.unify_nulls(m.assign_constants(classified, spec.constants))
    scaled = m.prescale(m.prescale(unified, spec.multiply), spec.divide, divide=True)
    species = m.convert_units(scaled, {**MOLAR_MASS, **spec.molar_mass})
    others = [c for c, t in TARGET_TYPES.items() if isinstance(t, T.DoubleType) and c not in CHEMISTRY]
    typed = m.null_negatives(parse_numbers(species, others))
    typed = typed.withColumn("Database_number", q("Database_number").cast("int")) if "Database_number" in typed.columns else typed
    return m.complete_schema(m.total_dissolved_solids(typed, spec.include_o2), keep=keep)


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """All parts below each other with the part's name as ``Database_name``; headers must agree in name and order."""
    (first, reference), *rest = parts.items()
    for name, part in rest:
        if part.columns != reference.columns:
            raise ValueError(f"columns of {name!r} differ from {first!r}: {part.columns} / {reference.columns}")
    merged = None
    for name, part in parts.items():
        named = part.withColumn("Database_name", F.lit(name))
        merged = named if merged is None else merged.unionByName(named)
    return merged
