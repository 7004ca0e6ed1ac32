"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hydrofold.llm import bpe, langid, mixing, similar, simhash, suffix_dedup
from hydrofold.llm.components import united
from hydrofold.llm.queries import tokenizer_path
from hydrofold.session import workspace

#: A text is rejected if its main language labels less than this share of its letters.
LEAST_SHARE = 0.3
#: SQL can express none of the stages but the mixing, so run()'s rows have no SQL.
ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; texts without a letter or without a main language go."""
    names = docs.columns
    found = langid.label(docs, langid.train(docs), language="_lang", score="_share", spans="_spans")
    return found.where((F.col("_lang") != "und") & (F.col("_share") >= LEAST_SHARE)).select(names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    Texts are joined by fingerprints of at most three different bits, as op7 finds them, and by five-word shingles that are
    0.8 similar or more, which also joins the near copies whose fingerprints lie further apart.
    """
    prints = simhash.with_components(docs).select("doc_id", "row", "component")
    return simhash.first_of_each(docs, united(prints, similar.with_groups(docs)), "text", "doc_id")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 200 bytes that occur elsewhere too; no document goes."""
    names = docs.columns
    cut = suffix_dedup.remove_repeats(docs, as_text=True)
    return cut.withColumns({"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}).select(names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source at the same weight, by Poisson numbers of copies, in a random order."""
    return mixing.mix(docs).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text they decode to."""
    vocabulary = tokenizer_path("byte_bpe_50k.json")
    decoded = bpe.encode(docs.select("doc_id", "text", "lang", "source"), vocabulary, decoded="decoded")
    return decoded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language id", identify), ("near duplicates", drop_near_duplicates), ("repeated passages", drop_repeats),
          ("mixing", mix_sources), ("tokens", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        folder = workspace(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
