"""Near duplicates by trie, repeated strings by suffix sorting, and components, against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hydrofold.llm import components, simhash, suffix_dedup


def brute_fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, budget=3):
    """Smallest reachable value of each value."""
    left, root = set(values), {}
    for start in sorted(left):
        if start in root:
            continue
        queue = [start]
        root[start] = start
        while queue:
            v = queue.pop()
            for w in left:
                if w not in root and (v ^ w).bit_count() <= budget:
                    root[w] = start
                    queue.append(w)
    return root


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_components_of_the_messy_table(messy, none):
    rows = simhash.with_components(messy).collect()
    texts = Counter((r["doc_id"], r["text"] or "") for r in messy.collect())
    prints = {t: brute_fingerprint(t) for _, t in texts}
    root, least = groups(prints.values()), defaultdict(list)
    for key, text in texts:
        least[root[prints[text]]].append(key)
    assert Counter((r["doc_id"], r["fingerprint"]) for r in rows) == Counter(
        {(k, signed(prints[t])): 0 for k, t in texts} | Counter((k, signed(prints[t])) for (k, t), n in texts.items() for _ in range(n)))
    by_key = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    for key, text in texts:
        if key is not None:
            assert by_key[key] == min(k for k in least[root[prints[text]]] if k is not None)
    assert simhash.with_components(none).count() == 0 and simhash.near_dedup(none).count() == 0


def test_one_row_of_each_group_stays(messy):
    kept = simhash.near_dedup(messy).collect()
    root = groups({brute_fingerprint(r["text"] or "") for r in messy.collect()})
    held = Counter(root[brute_fingerprint(r["text"] or "")] for r in kept)
    assert set(held.values()) == {1} and set(held) == set(root.values())
    assert all(r["_row"] == "x" and r["_kept"] == "y" for r in kept)
    assert sum(r["doc_id"] == 4 for r in kept) == 1 and 8 not in {r["doc_id"] for r in kept}


@pytest.mark.parametrize("group_rows", [10 ** 6, 20, 3])
def test_links_are_those_of_all_pairs(spark, group_rows):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(25)]
    values = set(centres) | {0, 1, 3, 7, (1 << 64) - 1, (1 << 63) - 1}
    for c in centres:  # chains around each centre, one of them large
        v = c
        for _ in range(60 if c == centres[0] else 8):
            for _ in range(rng.randint(1, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    df = spark.createDataFrame([(signed(v),) for v in values], "fingerprint long")
    found = components.components(simhash.links(df, 3, group_rows)).collect()
    root = groups(values)
    sizes = Counter(root.values())
    got = defaultdict(set)
    for r in found:
        got[r["root"]].add(r["node"])
    want = defaultdict(set)
    for v, r in root.items():
        if sizes[r] > 1:
            want[r].add(signed(v))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, None)]
    rows = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["root"] for r in rows} == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 130)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_removed(texts, length):
    times = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    marks = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if times[t[i:i + length]] > 1:
                mark[i:i + length] = b"\1" * length
        marks.append(mark)
    return marks


def check_removed(rows, texts, length):
    want = Counter()
    for text, mark in zip(texts, brute_removed(texts, length)):
        runs = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        want[text, bytes(b for b, m in zip(text, mark) if not m), len(text), sum(mark), runs] += 1
    assert Counter(((r["text"] or "").encode(), bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in rows) == want


def test_repeats_of_the_messy_table(messy, none):
    rows = suffix_dedup.remove_repeats(messy.where("doc_id <> 10 or doc_id is null")).collect()
    check_removed(rows, [(r["text"] or "").encode() for r in messy.collect() if r["doc_id"] != 10], 200)
    long = suffix_dedup.remove_repeats(messy.where("doc_id = 10")).first()
    assert long["n_bytes"] == 210_000 == long["n_removed"] and long["n_spans"] == 1
    assert suffix_dedup.remove_repeats(none).count() == 0
    text = suffix_dedup.remove_repeats(messy.where("doc_id = 15"), as_text=True).first()
    assert text["kept"] == text["text"] and text["_row"] == "x"


@pytest.mark.parametrize("bucket_contexts", [10 ** 6, 2])
def test_repeats_of_a_small_alphabet(spark, bucket_contexts):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcd ") for _ in range(90))
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) + (passage[rng.randint(0, 30):] if i % 2 else "") + "x" * (i % 40)
             for i in range(80)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row long, text string").repartition(3)
    spans = suffix_dedup.repeated_spans(df, "text", "row", 24, 8, bucket_contexts).collect()
    marks = [bytearray(len(t)) for t in texts]
    for s in spans:
        marks[s["row"]][s["low"]:s["high"]] = b"\1" * (s["high"] - s["low"])
    assert marks == brute_removed([t.encode() for t in texts], 24)


def test_suffixes_are_in_order():
    rng = random.Random(6)
    for _ in range(60):
        bodies = [bytes(rng.choice(b"\0ab\xff") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 5))]
        data, bounds = np.frombuffer(b"".join(bodies), np.uint8), np.cumsum([0, *map(len, bodies)])
        wanted = np.array(sorted(rng.sample(range(len(data)), rng.randint(1, len(data)))))
        order = suffix_dedup.suffix_order(data, bounds, wanted, 100)
        suffixes = [data[p:bounds[np.searchsorted(bounds, p, side="right")]].tobytes() for p in order]
        assert suffixes == sorted(suffixes) and set(wanted) <= set(order.tolist())


def test_texts_need_no_python_objects_of_the_driver(messy):
    assert simhash.with_fingerprints(messy.select("text")).where(F.col("text").isNull()).first()["fingerprint"] == 0
