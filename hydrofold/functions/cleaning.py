"""Cell cleaning: text tokens for missing values, censored numbers, decimal commas."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schema import q

# One pass over the text: the missing-value tokens, comparison marks, and Java's own float suffixes
# ("5d", "5f"), which Spark's cast would accept as numbers.
_NOISE = r"(?i)\bN/?D\b|[<>≈~]|^.*[0-9.][df]\s*$"
_FLOAT_SUFFIX = r"(?i)^.*[0-9.][df]\s*$"


def _finite_or_null(number: Column) -> Column:
    return F.nanvl(number, F.lit(None).cast("double"))


def clean_numeric(column: Column) -> Column:
    """Number in a dirty cell, else null: ``"<5"`` is 5.0, ``"N/D"``, blanks and other text are null."""
    return _finite_or_null(F.regexp_replace(column.cast("string"), _NOISE, "").try_cast("double"))


def numeric(column: Column) -> Column:
    """Number if the whole cell parses, else null; no token is removed."""
    return _finite_or_null(F.regexp_replace(column.cast("string"), _FLOAT_SUFFIX, "").try_cast("double"))


def decimal_comma(column: Column) -> Column:
    """Number written with a decimal comma, else null."""
    return numeric(F.replace(column.cast("string"), F.lit(","), F.lit(".")))


def text_columns(df: DataFrame, names: Iterable[str] | None = None) -> list[str]:
    """The columns of ``names`` (default all) that hold text."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return text if names is None else [n for n in names if n in text]


def apply_to_text(df: DataFrame, names: list[str], rule: Callable[[Column], Column]) -> DataFrame:
    """One rule on several text columns, in place.

    The rule runs as a lambda over an array of the cells. Written out per column, a dozen regular
    expressions make generated methods too long for the JVM to compile, which costs a factor of three.
    """
    if not names:
        return df
    cells = df.withColumn("_cells", F.transform(F.array(*[q(n) for n in names]), rule))
    return cells.withColumns({n: F.get("_cells", F.lit(i)) for i, n in enumerate(names)}).drop("_cells")


def parse_numbers(df: DataFrame, names: Iterable[str], parse: Callable[[Column], Column] = numeric) -> DataFrame:
    """Columns as doubles: text is parsed, numbers are taken as they are."""
    names = [n for n in names if n in df.columns]
    text = text_columns(df, names)
    plain = {n: _finite_or_null(q(n).cast("double")) for n in names if n not in text}
    return apply_to_text(df.withColumns(plain) if plain else df, text, parse)


def is_censored(column: Column) -> Column:
    """True for cells reported as below or above a detection limit."""
    return F.coalesce(column.cast("string").rlike("[<>]"), F.lit(False))


def unify_null(column: Column) -> Column:
    """Text cell, or null when it is blank or contains ``N/D``."""
    return F.when(~(column.rlike(r"^\s*$") | column.contains("N/D")), column)


def conform_name(header: str) -> str:
    """Header in comparable form: trimmed, lower case, runs of white space and underscores as one underscore."""
    return re.sub("__+", "_", re.sub(r"\s+", "_", header.strip().lower()))


def strip_transforms(column: Column) -> Column:
    """Feature name without the suffixes that transformations append."""
    return F.regexp_replace(column, r"(_log|_gauss|_boxcox).*$", "")
