"""The pipeline's stages, each on what the one before it kept."""

import __spark_entry__ as contract
import corpus_pipeline
from hydrofold.llm import similar, simhash
from hydrofold.llm.components import united

from .conftest import prose, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_registered():
    names = set(contract.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
    assert len(corpus_pipeline.STAGES) == 5


def test_stages(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert docs.columns == COLUMNS
    sizes = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tiny).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        sizes.append(docs.count())
        if i < 4:
            assert docs.columns == COLUMNS
    assert sizes[1] == sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2] and sizes[5] == sizes[4]
    assert docs.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_messy_and_empty_tables(spark, messy, tiny):
    for df in (messy.select(COLUMNS), messy.select(COLUMNS).limit(0)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, df, tiny)
            assert out.columns == COLUMNS and (out.count() > 0) == (df.count() > 0)


def test_near_duplicates_by_fingerprints_and_by_similarity(spark, tiny):
    words = prose(55, 60).split()
    similar_only = [" ".join(words), " ".join(words[:30] + ["other"] + words[31:])]
    prints_only = ["one two three " * 12 + "end", "one two three " * 12 + "five end"]
    docs = table(spark, [*similar_only, *prints_only, prose(77, 60)]).select(COLUMNS)
    near = {r["doc_id"]: r["component"] for r in simhash.with_components(docs).collect()}
    alike = {r["doc_id"]: r["component"] for r in similar.with_groups(docs).collect()}
    assert near[0] != near[1] and alike[0] == alike[1] and near[2] == near[3] and alike[2] != alike[3]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, tiny)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4]


def test_a_chain_through_both_groupings_is_one_group(spark):
    schema = "doc_id long, row long, component long"
    first = spark.createDataFrame([(1, 10, 7), (2, 20, 7), (3, 30, 8), (4, 40, 9), (None, 50, 6), (None, 50, 6)], schema)
    second = spark.createDataFrame([(1, 10, 10), (2, 20, 20), (3, 30, 20), (4, 40, 40), (None, 50, 50), (None, 50, 50)], schema)
    found = sorted((r["row"], r["component"]) for r in united(first, second).collect())
    assert found == [(10, 10), (20, 10), (30, 10), (40, 40), (50, 50), (50, 50)]
