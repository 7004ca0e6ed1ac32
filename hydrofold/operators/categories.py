"""Rock classes: dictionary lookups, one-to-many maps and free-text lithology."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import q

# --- fixed values: free-text lithology ---
# Whole keys whose classes differ from what their comma-separated words say.
LITHOLOGY_KEYS = {
    "limestone, dolostone": ["Limestone"],
    "anhydrite, dolomite": ["Dolomite"],
    "shale, black": ["Shale"],
    "ss, dolomitic?": ["Sandstone", "Dolomite"],
    "chalk": ["Limestone"],
    "carbonate, sandstone, shale, siltston": ["Limestone", "Sandstone", "Shale", "Siltstone"],
}
# Words with a class of their own; None is a class known to be unknown, which keeps the row.
# "dol" as Shale is the published table's value.
LITHOLOGY_WORDS = {
    "ss": ["Sandstone"], "sand stone": ["Sandstone"], "carbonate": ["Limestone"], "sand": ["Sand and Gravel"],
    "san": ["Sandstone"], "?": [None], "sha": ["Shale"], "dol": ["Shale"], "lime": ["Limestone"],
    "ga1n": [None], "ga1r": [None], "ga1g": [None],
    "limestone - dol": ["Limestone", "Dolomite"], "limestone dol": ["Limestone", "Dolomite"],
    "limestone dolom": ["Limestone", "Dolomite"], "dolomite - lime": ["Dolomite", "Limestone"],
    "lmsh": ["Limestone"], "ls": ["Limestone"], "granitic": ["Granite"],
}
LITHOLOGY_STOP_WORDS = ("unknown", "other", "n/a", "na", "none")


def map_category(df: DataFrame, column: str, classes: Mapping, output: str | None = None) -> DataFrame:
    """Dictionary lookup, unmapped values become null. The dictionary is a literal, so nothing is joined."""
    pairs = [F.lit(x) for pair in classes.items() for x in pair]
    key_type = "int" if all(isinstance(k, int) for k in classes) else "string"
    key = q(column).cast("string").try_cast("double").try_cast("int") if key_type == "int" else q(column)
    return df.withColumn(output or column, F.try_element_at(F.create_map(*pairs), key))


def _class_map(spark: SparkSession, classes: Mapping[str, list]) -> DataFrame:
    return spark.createDataFrame([(k, list(v)) for k, v in classes.items()], "_key string, _classes array<string>")


def expand_category(df: DataFrame, column: str, classes: Mapping[str, list[str]], output: str | None = None,
                    unknown: str = "keep") -> DataFrame:
    """One row per mapped class. Missing values stay once with a null class.

    Unmapped values stay the same way with ``unknown="keep"`` and vanish with ``"drop"``.
    """
    output = output or column
    keyed = df.withColumn("_key", F.lower(F.trim(q(column))))
    joined = keyed.join(F.broadcast(_class_map(df.sparkSession, classes)), "_key", "left")
    if unknown == "drop":
        joined = joined.where(F.col("_classes").isNotNull() | F.col("_key").isNull() | (F.col("_key") == ""))
    exploded = joined.select("*", F.explode_outer("_classes").alias("_class")).drop("_key", "_classes")
    return exploded.withColumn(output, F.col("_class")).drop("_class")


def lithology_key(text: Column) -> Column:
    """Comparable form: lower case, every separator as ``", "``."""
    text = reduce(lambda t, sep: F.replace(t, F.lit(sep), F.lit(",")), (";", "&", " and ", " or "), F.lower(F.trim(text)))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"\s*,\s*", ", "))


def title_case(text: Column) -> Column:
    """Every letter that does not follow a letter in upper case, the others in lower case."""
    pieces = F.split(F.regexp_replace(F.lower(text), r"(?<![\p{L}])(?=\p{L})", "\u0001"), "\u0001")
    first_letter_up = F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20)))
    return F.array_join(first_letter_up, "")


def expand_lithology(df: DataFrame, column: str, output: str = "rock_type",
                     keys: Mapping[str, list] = LITHOLOGY_KEYS, words: Mapping[str, list] = LITHOLOGY_WORDS,
                     stop_words=LITHOLOGY_STOP_WORDS, unknown: str = "drop") -> DataFrame:
    """One row per rock class named in free text.

    A whole key is looked up first, then each word: a class of its own, or its title-cased text. Stop
    words name no class; a text of stop words only drops the row (or keeps it with null class for
    ``unknown="keep"``). Missing text keeps the row with null class.
    """
    def literal_map(table):
        cells = [x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(c).cast("string") for c in v]))]
        return F.create_map(*cells)

    text = F.lower(F.trim(q(column)))
    missing = text.isNull() | text.isin("", "nan")
    tokens = F.filter(F.transform(F.split(F.col("_key"), ","), lambda t: F.trim(t)), lambda t: ~t.isin(*stop_words))
    by_word = F.flatten(F.transform(
        tokens, lambda t: F.coalesce(F.try_element_at(literal_map(words), t), F.array(title_case(t)))))
    classes = F.coalesce(F.try_element_at(literal_map(keys), F.col("_key")), by_word)
    explode = F.explode_outer if unknown == "keep" else F.explode
    return (
        df.withColumn("_key", F.when(~missing, lithology_key(q(column))))
        .withColumn("_classes", F.when(F.col("_key").isNull(), F.array(F.lit(None).cast("string"))).otherwise(classes))
        .select([q(c) for c in df.columns if c != output] + [explode("_classes").alias(output)])
    )
