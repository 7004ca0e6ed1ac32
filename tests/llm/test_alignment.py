"""Two tokenizations of the same texts, against the tokenizers' own libraries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hydrofold.llm import alignment
from hydrofold.llm.bpe import Vocabulary
from hydrofold.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text, document by document."""
    plain = Tokenizer.from_file(A)
    plain.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    a_bytes = Vocabulary(A).bytes
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, holds = [], Counter()
    for text in texts:
        ids = plain.encode(" " + text, add_special_tokens=False).ids if text else []
        pieces = b.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if b"".join(a_bytes[i] for i in ids) != whole or b"".join(map(piece, pieces)) != whole:
            ids, pieces = [], []
        ends_a = np.cumsum([len(a_bytes[i]) for i in ids]).tolist()
        ends_b = np.cumsum([len(piece(i)) for i in pieces]).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in common]
        for side, tokens, ends in ((0, ids, ends_a), (1, pieces, ends_b)):
            for token, end in zip(tokens, ends):
                groups[np.searchsorted(common, end)][side].append(token)
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        holds.update(links.keys())
        found.append((len(ids), len(pieces), groups, links))
    highest = defaultdict(int)
    for (x, _), n in holds.items():
        highest[x] = max(highest[x], n)
    return [(n_a, n_b, len(groups), sum(links.values()), sum(t for p, t in links.items() if holds[p] == highest[p[0]]),
             sum(t * holds[p] for p, t in links.items()), ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups))
            for n_a, n_b, groups, links in found]


ODD = ["<|endoftext|> and <s> </s><unk>", "▁ x ▁y", "a ▁b", " leading", "trailing ", "two  spaces   three \n lines\n\n\tend \n", " nbsp  em \x1c fs",
       "it's we'll 'tis", "123 4567 89", "日本語 の テキスト", "é \U0001f600\U0001f468‍\U0001f469", "\x00 zero", "<0x41> <0x0A>", "x" * 500, "ab1" * 300, " ", "\n", ". ! ?", "co-operate re-do"]


@pytest.mark.parametrize("links,stretch,words", [(alignment.CHUNK_LINKS, alignment.STRETCH, alignment.ROW_WORDS), (50, 40, 3)])
def test_rows_equal_the_libraries(spark, messy, monkeypatch, links, stretch, words):
    monkeypatch.setattr(alignment, "STRETCH", stretch)
    monkeypatch.setattr(alignment, "ROW_WORDS", words)
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    df = messy.where("doc_id is null or doc_id <> 10").unionByName(odd, allowMissingColumns=True).repartition(3)
    rows = df.select("doc_id", "text").collect()
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, *w) for r, w in zip(rows, brute([r["text"] or "" for r in rows])))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, *r[1:]) for r in alignment.scored(df, A, B, groups="text", chunk_links=links).collect())
    assert got == want
    digests = {r["doc_id"]: r["groups"] for r in alignment.scored(df, A, B, chunk_links=links).collect()}
    assert all(digests[k if k >= 0 else None] == (hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for k, *w in want if k >= 0)


def test_columns_and_empty_table(spark, messy, none):
    assert alignment.scored(none, A, B).count() == 0
    out = alignment.scored(messy.where("doc_id in (5, 6)"), A, B)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert [tuple(r)[1:] for r in out.collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_large_groups_are_counted_by_distinct_tokens(monkeypatch):
    ids = np.arange(6) % 2, np.arange(4) % 3
    ends = np.array([2, 4, 6, 8, 10, 12]), np.array([3, 5, 7, 12])
    run = lambda: alignment.lockstep(*ids, *ends, *(np.array([x]) for x in (0, 0, 6)))
    count = lambda m: Counter({k: int(n) for k, n in _sums(m, ids)})
    plain = count(run())
    monkeypatch.setattr(alignment, "LARGE_GROUP", 3)
    assert count(run()) == plain and sum(plain.values()) == 24


def _sums(merged, ids):
    found = Counter()
    for a, b, times in merged.links:
        for x, y, n in zip(a, b, times):
            found[int(ids[0][x]), int(ids[1][y])] += n
    return found.items()


def test_very_long_texts(spark):
    long = ["word and " * 300_000, "w" * 200_000, " " * 300_000 + "x"]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in alignment.scored(df, A, B).collect()}
    pair = alignment._Pair(alignment.Tokenizers(A, B))
    for i, text in enumerate(long):
        a, b = [len(ids) for ids, _ in pair.words([text])] if i else (600_001, 600_001)
        assert (rows[i]["n_a"], rows[i]["n_b"]) == (a, b)
    assert rows[0]["n_groups"] == 600_001
