"""Numeric features with normal scores, ready for maps and imputers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.cleaning import parse_numbers
from ..operators.features import gaussianize, log_transform
from ..operators.filters import null_sentinel
from ..schema import q


def preprocess(df: DataFrame, columns: list[str], metadata: list[str], period: str | None = None, key: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Coerce, take logs of skewed columns, add normal scores; {column: scored column}.

    Output columns: key, metadata, raw features, scores, in that fixed order.
    """
    df = null_sentinel(df, period) if period else df
    numbers = parse_numbers(df, columns)
    logged, names = log_transform(numbers, columns)
    scored, scores = gaussianize(logged, names)
    raw_of = {f"{n}_gauss": n.removesuffix("_log") for n in names}
    kept = ([key] if key else []) + [c for c in metadata if c in df.columns] + columns + scores
    return scored.select([q(c) for c in dict.fromkeys(kept)]), {raw_of[s]: s for s in scores}
