"""Ids beyond 2^53 beside a null, and other whole numbers that operators carry, stay as they are."""

import pytest

import corpus_pipeline
from loomwork.llm import nearcopies, ngram_lm, rollup, simhash, spm
from loomwork.llm.common import map_texts

BIG = 2**53 + 1
ROWS = [(BIG, "some words of one text", "en", "a", BIG + 2, 5), (None, "other words", "en", "a", None, None), (-BIG, None, None, None, BIG, 2**62 + 1), (2**63 - 1, "the last of the texts", "de", "b", None, None)]
IDS = sorted(str(r[0]) for r in ROWS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long, extra long").coalesce(1)


def ids(df, name="doc_id"):
    return sorted(str(r[name]) for r in df.select(name).collect())


def test_operators(docs):
    assert ids(simhash.fingerprints(docs)) == IDS
    assert ids(simhash.components(docs)) == IDS
    assert ids(spm.summary(docs)) == IDS
    assert ids(ngram_lm.train_and_score(docs)) == IDS
    assert ids(rollup.count_tokens(docs, rollup.VOCABULARY, "t")) == IDS
    assert ids(nearcopies.keep_first(docs)) == IDS


def test_every_carried_column(docs):
    encoded = spm.encode(docs)
    for k, name in ((0, "doc_id"), (4, "n_chars"), (5, "extra")):
        assert ids(encoded, name) == sorted(str(r[k]) for r in ROWS)
    clash = docs.withColumnRenamed("extra", "_text")
    out = map_texts(clash, "text", lambda: lambda texts: {"n": [len(t or "") for t in texts]}, "n int")
    assert out.columns == [*clash.columns, "n"] and ids(out, "_text") == sorted(str(r[5]) for r in ROWS)
    assert {r["text"]: r["n"] for r in out.collect()} == {r[1]: len(r[1] or "") for r in ROWS}


def test_stages_keep_ids(spark, sf, docs):
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.secret_scan, corpus_pipeline.tokens):
        out = stage(spark, docs, sf)
        assert ids(out) == IDS and ids(out, "n_chars") == sorted(str(r[4]) for r in ROWS)


def test_results_of_two_calls_of_a_stage_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        first, second = stage(spark, docs.where("doc_id < 60"), sf), stage(spark, docs.where("doc_id >= 60"), sf)
        assert first.count() > 0 and second.count() > 0 and first.count() > 0
