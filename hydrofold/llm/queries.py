"""Registered queries of the operators, one per operator, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, bpe, katz, langid, line_crf, ring, url_filter
from .cross_polytope import nearest
from .hard_negatives import mine
from .mixing import mix
from .quality_rules import RULES, STOP_WORDS, judged
from .simhash import with_components
from .suffix_dedup import remove_repeats
from .texts import crc_mod

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on the driver; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register()
def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"))
    model = langid.train(docs.where("not held_out"))
    return langid.label(docs.select("doc_id", "held_out", "text"), model).select(
        "doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


@register()
def op2_bpe(spark, sf_dir):
    vocabulary = tokenizer_path("byte_bpe_50k.json")
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, decoded="decoded").select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register()
def op3_katz(spark, sf_dir):
    return katz.scored(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 5) == 1)


def _rules_sql() -> str:
    bounds = [f"{r.count} >= CAST({r.least} AS DOUBLE) * {r.of}" for r in RULES if r.least is not None]
    bounds += [f"{r.count} <= CAST({r.most} AS DOUBLE) * {r.of}" for r in RULES if r.most is not None]
    return " AND ".join(bounds)


BLANK_SQL = r"[\x20\x09-\x0D]"
QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT doc_id, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words,
      list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS win
            FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 6, 1))) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c > 1),
repeats AS (SELECT doc_id, sum(least(8, coalesce(following - i, 8))) AS n
            FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM twice) GROUP BY doc_id),
word AS (SELECT doc_id, i, words[i] AS w, words[i + 1] AS following FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)),
per_word AS (SELECT doc_id,
   sum(CASE WHEN length(w) > 1 AND upper(w) = w AND lower(w) <> w THEN 1 ELSE 0 END) AS n_shouted,
   sum(CASE WHEN following = w THEN 1 ELSE 0 END) AS n_stuttered,
   sum(CASE WHEN lower(rtrim(w, '.,;:!?')) IN ({", ".join(repr(x) for x in STOP_WORDS)}) THEN 1 ELSE 0 END) AS n_stop_words
   FROM word GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
   CAST(length(regexp_replace(body, '{BLANK_SQL}', '', 'g')) AS BIGINT) AS word_chars,
   CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
   CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
   CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(length(body) - length(replace(body, '!', '')) AS BIGINT) AS n_exclamations,
   CAST(coalesce(p.n_shouted, 0) AS BIGINT) AS n_shouted, CAST(coalesce(p.n_stuttered, 0) AS BIGINT) AS n_stuttered,
   CAST(coalesce(p.n_stop_words, 0) AS BIGINT) AS n_stop_words
   FROM w LEFT JOIN repeats r ON w.doc_id = r.doc_id LEFT JOIN per_word p ON w.doc_id = p.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {_rules_sql()} AS kept FROM b
"""


@register(QUALITY_SQL)
def op4_quality_rules(spark, sf_dir):
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


URL_RULES = [
    url_filter.Rule("allow", "com/"), url_filter.Rule("block", "example.com/en/"), url_filter.Rule("allow", "www.example.com/en/"),
    url_filter.Rule("block", "net/es/"), url_filter.Rule("block", "net/fr/")]


@register()
def op5_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judged(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "llr")


@register()
def op6_line_crf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 4) != 2)
    model = line_crf.train(docs.where("not held_out"), labels)
    return line_crf.score(docs, model).select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@register()
def op7_simhash_dedup(spark, sf_dir):
    found = with_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@register()
def op8_cross_polytope(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@register()
def op10_suffix_dedup(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


MIX_SQL = """
WITH sources AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
total AS (SELECT sum(n) AS total, count(*) AS k FROM sources),
rates AS (SELECT source, (1e0 / k) * total / n AS rate FROM sources, total),
steps AS (SELECT unnest(range(0, 400)) AS j),
terms AS (SELECT source, j, exp(-rate + j * ln(rate) - lgamma(j + 1)) AS p FROM rates, steps
          WHERE j <= CAST(floor(rate + 12e0 * sqrt(rate) + 30e0) AS BIGINT)),
sums AS (SELECT source, j, sum(p) OVER (PARTITION BY source ORDER BY j) AS s FROM terms),
drawn AS (SELECT doc_id, source,
          CAST(concat('0x', substr(md5(concat('7:', CAST(doc_id AS VARCHAR), ':1')), 1, 13)) AS BIGINT) / 4503599627370496e0 AS u FROM documents),
copies AS (SELECT d.doc_id, count(*) AS n FROM drawn d JOIN sums s ON d.source IS NOT DISTINCT FROM s.source AND s.s <= d.u GROUP BY d.doc_id),
numbers AS (SELECT unnest(range(1, 400)) AS copy)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(c.copy AS INTEGER) AS copy,
       md5(concat('7/', CAST(d.doc_id AS VARCHAR), '/', CAST(c.copy AS VARCHAR))) AS shuffle_key
FROM documents d JOIN copies n ON d.doc_id = n.doc_id JOIN numbers c ON c.copy <= n.n
"""


@register(MIX_SQL)
def op9_source_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


NEGATIVES_SQL = """
WITH u AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, u.vec_id AS other, a.label = u.label AS same, CAST(list_inner_product(a.v, u.v) AS BIGINT) AS score
      FROM u a JOIN u ON a.vec_id <> u.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
        CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS INTEGER) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@register(NEGATIVES_SQL)
def op12_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("vec_id") % 100 == 0)


@register()
def op13_sharding(spark, sf_dir):
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return ring.place(docs, 16, ties=("size", "text_crc32")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register()
def op11_alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.scored(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")).withColumnRenamed("groups", "groups_sha256")
