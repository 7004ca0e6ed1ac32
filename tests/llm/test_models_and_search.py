"""Katz backoff, URL models and nearest neighbours, against brute force."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrofold.llm import cross_polytope, katz, url_filter
from hydrofold.llm.texts import crc_mod


def brute_katz(rows, held):
    words, pairs, histories = Counter(), Counter(), Counter()
    split = [[*(t or "").encode().lower().split(), b""] for _, t in rows]
    for tokens, out in zip(split, held):
        if not out:
            words.update(tokens)
            for h, w in zip([None, *tokens], tokens):
                pairs[h, w] += 1
                histories[h] += 1
    total, types = sum(words.values()), len(words)

    def factors(counter):
        return katz.discounts(np.array([sum(v == r for v in counter.values()) for r in range(1, katz.DISCOUNTED + 2)]))

    one, two = factors(words), factors(pairs)
    off = lambda c, f: c * (f[c] if c <= katz.DISCOUNTED else 1.0)
    unknown = (total - sum(off(c, one) for c in words.values())) / total
    chance = lambda w: off(words[w], one) / total if w in words else unknown
    after = defaultdict(list)
    for (h, w), c in pairs.items():
        after[h].append((w, c))

    def weight(h):
        if h not in histories:
            return 1, 1.0
        kept = sum(off(c, two) for _, c in after[h])
        divisor = histories[h] + (histories[h] - kept < 1e-9)
        return divisor, (1 - kept / divisor) / (1 - sum(chance(w) for w, _ in after[h]))

    def probability(h, w):
        divisor, factor = weight(h)
        return off(pairs[h, w], two) / divisor if (h, w) in pairs else factor * chance(w)

    scores = [(len(t), sum(w in words for w in t), total, sum(math.log10((words[w] + 0.5) / (total + 0.5 * (types + 1))) for w in t),
               sum(math.log10(probability(h, w)) for h, w in zip([None, *t], t))) for t in split]
    sums = [sum(probability(h, w) for w in words) + probability(h, b"\xff never") for h in (None, split[0][0], split[3][1], b"\xff never")]
    return scores, sums


@pytest.mark.parametrize("size", [2_000_000, 400])
def test_scores_equal_brute_force(messy, none, size):
    held = crc_mod(F.col("doc_id"), 5) == 1
    rows = katz.scored(messy.where("doc_id <> 10"), held, part_tokens=size, part_words=size).collect()
    texts = [(r["doc_id"], r["text"]) for r in messy.collect() if r["doc_id"] is not None and r["doc_id"] != 10]
    out = [zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in texts]
    want, sums = brute_katz(texts, out)
    assert np.allclose(sums, 1, atol=1e-12)
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts)
    for (key, _), is_out, (n, known, total, base, score) in zip(texts, out, want):
        r = got[key]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (is_out, n, known, total)
        assert r["base_score"] == pytest.approx(base, abs=1e-7) and r["score"] == pytest.approx(score, abs=1e-7)
    assert katz.scored(none, held).count() == 0
    untaught = katz.scored(messy.limit(3), F.lit(True)).collect()
    assert all(r["score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in untaught)


def test_packing():
    arrays = [np.array([], np.int64), np.array([0, 5, 2 ** 33]), np.arange(1000) % 7]
    assert all(np.array_equal(a, b) for a, b in zip(arrays, katz.unpack(katz.pack(*arrays))))


RULES = [url_filter.Rule("allow", "com/"), url_filter.Rule("block", "example.com/en/"), url_filter.Rule("allow", "www.example.com/en/"),
         url_filter.Rule("block", "net/es/")]


def test_rules_and_addresses(spark):
    cases = {
        "HTTP://WWW.Example.COM/en/1?x=/": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://a.example.com/en/#t": ("a.example.com", "/en/", "example.com/en/", "block"),
        "https://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"), "x://com": ("com", "", None, None),
        "x://b.net/es/?q": ("b.net", "/es/", "net/es/", "block"), "x://b.net/es": ("b.net", "/es", None, None),
        "x://É.NET?a://b": ("É.net", "", None, None), "x://h\n.com/p\nq#z": ("h\n.com", "/p\nq", "com/", "allow"),
        "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow")}
    df = spark.createDataFrame([(i, u, 9, "own") for i, u in enumerate(cases)], "page_id long, url string, _ruled int, _rest string")
    for r in url_filter.judged(df, RULES).collect():
        host, path, rule, verdict = cases[r["url"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ([verdict] if verdict else ["allow", "block"])
        assert r["_ruled"] == 9 and r["_rest"] == "own"
    assert url_filter.judged(df.limit(0), RULES).count() == 0


def test_models_tell_kinds_of_urls_apart(spark):
    rows = [(i, f"http://news{i % 9}.example.com/story/{i}") for i in range(120)] + [(1000 + i, f"http://pills{i % 9}.shop.net/es/buy-{i}") for i in range(120)]
    rows += [(2000, "http://news7.example.org/story/5"), (2001, "http://pills3.shop.org/es/buy-77")]
    verdicts = {r["page_id"]: r["verdict"] for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string"), RULES).collect()}
    assert verdicts[2000] == "allow" and verdicts[2001] == "block"


def brute_nearest(vectors, k):
    ids = sorted(vectors)
    matrix = np.array([vectors[i] for i in ids], float)
    out = {}
    for i in (i for i in ids if i % 20 == 0):
        scores = (matrix * np.array(vectors[i], float)).sum(axis=1)
        others = [(-s, j) for s, j in zip(scores, ids) if j != i]
        out[i] = [(j, -s) for s, j in sorted(others)[:k]]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 16)) * rng.uniform(0.5, 3, (400, 1))
    base[100:240] = base[100] * 20 / np.linalg.norm(base[100])  # a third of all rows are one vector
    good = {i: base[i].astype(np.float32).astype(float).tolist() for i in range(400)}
    odd = {1000: None, 1020: [0.0] * 16, 1040: [float("nan")] * 16, 1060: [1.0] * 15 + [None], 1080: [float("inf")] * 16, 1100: [1.0] * 5}
    df = spark.createDataFrame([(i, v, 0) for i, v in {**good, **odd}.items()], "vec_id long, embedding array<float>, rank int")
    rows = cross_polytope.nearest(df, F.col("vec_id") % 20 == 0, k=7, block_rows=60).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute_nearest(good, 7)
    assert set(got) == set(want) and all(len(v) == 7 for v in got.values())
    hits = sum(len({i for i, _ in got[k]} & {i for i, _ in want[k]}) for k in want)
    assert hits >= 0.9 * 7 * len(want)
    assert [i for i, _ in got[100]] == list(range(101, 108))  # ties go to the smaller key
    for found in got.values():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    assert cross_polytope.nearest(df.limit(0), F.lit(True)).count() == 0


def test_few_vectors_are_all_found(spark):
    df = spark.createDataFrame([(i, [float(i + 1), float(i % 3), 1.0]) for i in range(6)], "vec_id long, embedding array<float>")
    rows = cross_polytope.nearest(df, F.col("vec_id") == 0, tables=1, probes=1).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in rows] == [(i + 1, 5 - i) for i in range(5)]


def test_hadamard_turns_keep_lengths():
    hasher = cross_polytope.Hasher(5, 2.0, 2, 1)
    unit = hasher.lifted(np.random.default_rng(0).normal(size=(9, 5)) / 5)
    assert np.allclose((hasher.rotated(unit, 1) ** 2).sum(axis=1), 1)
