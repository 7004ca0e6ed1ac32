"""A table with everything a corpus can hold: nulls, empty and long texts, repeats, and columns called like internal ones."""

import random

import pytest
from pyspark.sql import functions as F

SYLLABLES = {"en": "the of and ing tion er re on at en".split(), "de": "der die und ung keit sch lich ein ge ver".split()}


def prose(seed: int, words: int, lang: str = "en") -> str:
    rng = random.Random(seed)
    made = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return " ".join(w + (".\n" if rng.random() < 0.1 else "") for w in made)


SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _row string, _null long, _kept string, _words int, "
          "_lines int, kept string, fingerprint string, ids string, score string, _rate int, copy string, quality int")


def table(spark, texts, langs=None):
    rows = []
    for i, text in enumerate(texts):
        lang = (langs or ["en", "de"])[i % 2]
        rows.append((i, text, lang, f"s{i % 3}" if i % 7 else None, len(text) if text is not None else None, *["x", 1, "y", 2, 3, "k", "f", "i", "s", 4, "c"], i % 2))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def messy(spark):
    texts = [prose(i, 60 + 5 * i, "en" if i % 2 == 0 else "de") for i in range(40)]
    texts[5], texts[6], texts[7], texts[8] = None, "", "12 34 !!\n\n \t", texts[4]
    texts[9] = texts[4] + " end"
    texts[10] = "ab " * 70_000  # one very long text, all repeats
    texts[11] = prose(99, 30) + texts[12][50:400]
    texts[13] = texts[14] = "a b c"
    texts[15] = "naïve café 你好世界 \U0001f600 end"
    df = table(spark, texts)
    repeated = df.where("doc_id = 4")
    keyless = df.where("doc_id in (16, 17)").withColumn("doc_id", F.lit(None).cast("long"))
    return df.unionByName(repeated).unionByName(keyless).repartition(4).persist()


@pytest.fixture(scope="module")
def none(messy):
    return messy.limit(0)


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]
