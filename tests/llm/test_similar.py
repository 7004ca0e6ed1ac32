"""The pipeline's near-duplicate stage on planted near copies, and its groups against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hydrofold.llm import similar

from .conftest import rows_of, table

WORDS = [f"word{i}" for i in range(4000)]


def made(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def edited(rng, words, edits):
    words = list(words)
    for i in rng.sample(range(len(words)), edits):
        words[i] = f"new{rng.randrange(10 ** 9)}"
    return words


def shingled(text):
    words = (text or "").lower().encode().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_groups(texts):
    """Sets of indices, joined by every pair of similarity 0.8 or more."""
    sets, root = [shingled(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(set)
    for i in range(len(texts)):
        groups[find(i)].add(i)
    return set(map(frozenset, groups.values()))


def test_planted_near_copies_go_and_others_stay(spark, tiny):
    rng, texts, copies = random.Random(1), [], 0
    for words, edits in ((60, 1), (150, 1), (150, 3), (400, 8), (1000, 20)) * 8:
        first = made(rng, words)
        second = edited(rng, first, edits)
        while 10 * len(shingled(" ".join(first)) & shingled(" ".join(second))) < 8 * len(shingled(" ".join(first)) | shingled(" ".join(second))):
            second = edited(rng, first, edits)
        texts += [" ".join(first), " ".join(second), " ".join(edited(rng, first, words // 8))]  # the third is not similar
        copies += 1
    df = table(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, tiny).collect()}
    assert kept == {i for i in range(3 * copies) if i % 3 != 1}


@pytest.mark.parametrize("all_pairs", [8, 1])
def test_groups_are_those_of_all_pairs(spark, messy, none, all_pairs):
    rng, texts = random.Random(2), []
    for size in (3, 60, 12):  # chains and stars of copies, some at the edge of similarity
        base = made(rng, 80)
        group = [base]
        for _ in range(size):
            group.append(edited(rng, rng.choice(group), rng.randint(0, 3)))
        texts += [" ".join(w) for w in group]
    texts += [None, "", " \n", "a b c", "A  b\nc", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = defaultdict(set)
    for r in similar.with_groups(df, all_pairs=all_pairs).collect():
        found[r["component"]].add(r["doc_id"])
    assert set(map(frozenset, found.values())) == brute_groups(texts)
    assert similar.near_dedup(none).count() == 0
    if all_pairs == 8:
        kept = rows_of(similar.near_dedup(messy))
        plain = rows_of(messy)
        assert len(kept) == len(brute_groups([t for _, t in plain])) and all(k in plain for k in kept)


def test_overlaps_are_those_of_the_sets(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 5, 30, 30, 50, 1, 80)]
    flat, owner = np.concatenate(sets[2:6]), np.repeat(np.arange(4), [len(x) for x in sets[2:6]])
    order = np.argsort(flat, kind="stable")
    for work in (similar.WORK, 1):
        monkeypatch.setattr(similar, "WORK", work)
        found = list(similar.overlaps(np.concatenate(sets), np.array([len(x) for x in sets]), flat[order], owner[order], 4))
        assert np.concatenate([x for _, x in found]).tolist() == [[len(np.intersect1d(a, b)) for b in sets[2:6]] for a in sets]


def test_crowded_buckets_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similar, "CENTRES", 3)
    monkeypatch.setattr(similar, "CENTRES_GROW", 2)
    monkeypatch.setattr(similar, "PART_ROWS", 7)
    rng = random.Random(3)
    first = made(rng, 120)
    texts = [" ".join(edited(rng, first, rng.randrange(5))) for _ in range(70)] + [" ".join(first[:100] + made(rng, 20)) for _ in range(30)]
    got = defaultdict(set)
    for r in similar.with_groups(table(spark, texts), all_pairs=2).collect():
        got[r["component"]].add(r["doc_id"])
    assert set(map(frozenset, got.values())) == brute_groups(texts)
