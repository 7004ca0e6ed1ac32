"""BPE, language identification, quality rules, the line model and mixing, on the messy table."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hydrofold.llm import bpe, langid, line_crf, mixing, quality_rules
from hydrofold.llm.texts import crc_mod

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_tokens_equal_the_library_and_come_back(messy, none):
    library = Tokenizer.from_file(VOCABULARY)
    rows = bpe.decode(bpe.encode(messy, VOCABULARY, decoded="again"), VOCABULARY).where("again = decoded").collect()
    assert len(rows) == messy.count()
    for r in rows:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n_tokens"] == len(want)
        assert r["decoded"] == (r["text"] or "")
    assert bpe.decode(bpe.encode(none, VOCABULARY), VOCABULARY).count() == 0


def test_pairs_are_judged_as_the_merges_do(spark):
    v = bpe.Vocabulary(VOCABULARY)
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 5000, 400), rng.integers(0, 5000, 400)
    merged = [v.merged(v.bytes[x] + v.bytes[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert v.compatible(a, b).tolist() == merged and 0 < sum(merged) < 400


def test_merging_side_by_side_equals_step_by_step():
    v, rng = bpe.Vocabulary(VOCABULARY), random.Random(1)
    words = [bytes(rng.choice(b"aeiourstnlmhcdp ") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    words += [bytes(rng.randrange(256) for _ in range(rng.randint(1, 33))) for _ in range(1000)]
    words += [letter * n for letter in (b"a", b"\0", b" ") for n in range(1, 40)]
    assert v.merged_all(words) == [v.merged(w) for w in words] and v.merged_all([]) == []


def test_special_tokens_and_odd_white_space(spark):
    library = Tokenizer.from_file(VOCABULARY)
    texts = ["<|endoftext|>", " a  <|endoftext|>  b", "\0<|endoftext|>\x1c\x85\u2003 x", "aaaa" * 900, "don't  'LL 12³"]
    flat, ends = bpe._Encoder(bpe.Vocabulary(VOCABULARY))(texts)
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_languages(messy, none, spark):
    model = langid.train(messy.where(crc_mod(F.col("doc_id"), 3) != 1).where("doc_id not in (5, 6, 7, 10, 13, 15)"))
    rows = langid.label(messy, model).collect()
    plain = [r for r in rows if r["doc_id"] is not None and (r["doc_id"] > 17 or r["doc_id"] < 4)]
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in plain) and len(plain) == 26
    lost = {r["doc_id"]: r for r in rows if r["doc_id"] in (5, 6, 7)}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["spans"] == [] for r in lost.values())
    assert next(r for r in rows if r["doc_id"] == 15)["lang_pred"] in ("en", "de")
    untaught = langid.label(messy, langid.train(none))
    assert {r["lang_pred"] for r in untaught.collect()} == {"und"} and langid.label(none, model).count() == 0


def test_best_path_is_the_best(spark):
    rng = np.random.default_rng(1)
    for n in (1, 7, 300):
        scores, penalty = rng.normal(size=(n, 3)) * 3, np.where(rng.random(n) < 0.1, 0.0, 2.5)
        best = scores[0]
        for s, p in zip(scores[1:], penalty[1:]):
            best = np.maximum(best, best.max() - p) + s
        path = langid.best_path(scores, penalty)
        value = scores[np.arange(n), path].sum() - penalty[1:][path[1:] != path[:-1]].sum()
        assert np.isclose(value, best.max())


def test_spans_of_a_mixed_text(messy, spark):
    from .conftest import prose

    model = langid.train(messy.where("doc_id > 17"))
    text = prose(1, 40) + " " + prose(2, 40, "de")
    row = langid.label(spark.createDataFrame([(text,)], "text string"), model).first()
    assert [s["lang"] for s in row["spans"]] == ["en", "de"] and abs(row["spans"][1]["start"] - len(prose(1, 40))) < 12


def counted(text):
    words = text.split() if text.isascii() else [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(messy, none):
    for r in quality_rules.judged(messy).collect():
        want = counted(r["text"] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["base_failed"] and r["kept"])
        assert r["_words"] == 2 and r["_lines"] == 3
    assert quality_rules.judged(none).count() == 0


def test_quality_plan_is_native(messy):
    plan = quality_rules.judged(messy)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.replace("InMemoryTableScan", "").split("InMemoryRelation")[0]


def noisy(seed, lines, good):
    from .conftest import prose

    text = [prose(seed * 100 + i, 12).replace("\n", "") for i in range(lines)]
    return "\n".join(t if good or i % 3 == 0 else " ".join(w + "$$$" for w in t.split()) for i, t in enumerate(text))


def test_line_model(messy, none, spark):
    rows = [(i, noisy(i, 2 + i % 5, i % 2 == 0), 1 - i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = line_crf.train(df, df.where("doc_id < 140"))
    held = line_crf.score(df.where("doc_id >= 140"), model).collect()
    assert sum((r["score"] >= 0.7) == r["quality"] for r in held) >= 58
    scores = line_crf.score(messy, model).collect()
    assert len(scores) == messy.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert len({r["score"] for r in scores if not r["text"]}) == 1
    assert line_crf.score(none, model).count() == 0
    for part, want in ((none, 0.5), (df.where("quality = 1"), 1.0)):
        assert line_crf.score(df.limit(3), line_crf.train(df, part)).first()["score"] == pytest.approx(want, abs=1e-6)


def test_line_model_without_texts_or_with_long_ones(spark, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    half = line_crf.train(none, labels)  # labels, but no document
    assert line_crf.score(spark.createDataFrame([("a",)], "text string"), half).first()["score"] == pytest.approx(0.5)
    good, bad = "a plain line of words\n" * 300, "#$%& !!! <<< >>>\n" * 300
    texts = [(i, good if i % 2 else bad) for i in range(40)] + [(5, good)] * 30
    model = line_crf.train(spark.createDataFrame(texts, "doc_id long, text string"), labels)
    scores = [r["score"] for r in line_crf.score(spark.createDataFrame([(good,), (bad,)], "text string"), model).collect()]
    assert scores[0] > 0.8 and scores[1] < 0.2
    only = line_crf.train(spark.createDataFrame([(i, good) for i in range(1, 40, 2) if i not in (3,)], "doc_id long, text string"), labels)
    assert line_crf.score(spark.createDataFrame([("a",)], "text string"), only).first()["score"] == pytest.approx(1, abs=1e-6)
    few = line_crf.train(spark.createDataFrame(texts, "doc_id long, text string"), labels, most=10)
    assert np.isfinite(few.weights).all()


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    state, move = rng.normal(size=(7, 2)), rng.normal(size=(2, 2))
    first = np.array([0, 4, 5, 7])
    good, total, moves = line_crf.marginals(state, move, first, pairs=True)
    want, steps = np.zeros(7), np.zeros((2, 2))
    for chain, (a, b) in enumerate(zip(first, first[1:])):
        paths = [[p >> i & 1 for i in range(b - a)] for p in range(1 << (b - a))]
        weight = np.array([np.exp(sum(state[a + i, y] for i, y in enumerate(p)) + sum(move[y, z] for y, z in zip(p, p[1:]))) for p in paths])
        assert np.isclose(np.log(weight.sum()), total[chain])
        for p, w in zip(paths, weight / weight.sum()):
            want[a:b] += w * np.array(p)
            for y, z in zip(p, p[1:]):
                steps[y, z] += w
    assert np.allclose(good, want) and np.allclose(moves, steps)


def test_mixing_draws(messy, none, spark):
    rows = mixing.mix(messy, weights={"s0": 0.5}, epochs=40.0).collect()
    sizes, total = Counter(r["source"] for r in rows), messy.count() * 40
    assert abs(sizes["s0"] / total - 0.5) < 0.1 and set(sizes) == {"s0", "s1", "s2", None}
    copies = Counter((r["doc_id"], r["text"]) for r in rows)
    again = Counter((r["doc_id"], r["text"]) for r in mixing.mix(messy.repartition(3), weights={"s0": 0.5}, epochs=40.0).collect())
    assert copies == again and all(r["_rate"] == 4 for r in rows)
    assert mixing.mix(none).count() == 0
    large = spark.range(3).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "rare").otherwise("many").alias("source"))
    drawn = Counter(r["source"] for r in mixing.mix(large, epochs=4000.0).collect())
    assert all(abs(n - 6000) < 6 * 6000 ** 0.5 for n in drawn.values())  # a rate of 6000 is a sum of parts


def test_poisson_steps(spark):
    row = spark.range(1).select(mixing._cumulative(F.lit(3.0)).alias("s")).first()["s"]
    p = np.cumsum([np.exp(-3.0) * 3.0 ** k / np.prod(np.arange(1, k + 1), dtype=float) for k in range(len(row))])
    assert np.allclose(row, p) and 1 - row[-1] < 1e-12


def test_digest_of_ids(spark):
    row = bpe.encode(spark.createDataFrame([("hello world",)], "text string"), VOCABULARY).select(F.sha2("ids", 256).alias("d")).first()
    ids = Tokenizer.from_file(VOCABULARY).encode("hello world").ids
    assert row["d"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
