"""The corpus pipeline, stage by stage, against what each stage's operator says."""

import math

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_near_copies import brute_kept

from loomwork.llm import mixing, secrets
from loomwork.llm.common import materialize

LONG = "lorem ipsum dolor sit amet " * 20_000
ODD = [
    (1, "the cat sat on the mat and slept all day in the house", "en", "a", 1),
    (1, "the cat sat on the mat and slept all day in the house", "en", "a", 1),
    (2, "The cat sat on the mat and slept all day in the house", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, LONG, "en", None, 1),
    (None, "no name at all but a text of the language", "en", "a", 1),
    (6, "  \n\t ", "de", "", 5),
    (7, "the word password = abcdefghijkl0123 stands in the text of this one", "en", "b", 1),
]


def by_source(docs):
    return {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("n")).collect()}


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_rows(spark, sf, rows):
    """Nulls, empty and long texts, repeats and clashing names through every stage; and an empty table."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({n: F.lit(n) for n in ("_base", "id", "node", "key", "times", "size", "component", "fp", "digest", "p_source", "token_ids2")})
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = materialize(stage(spark, docs, sf), "stage")
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns, name
        assert bool(out.count()) == bool(rows), name
        if rows and name == "secret scans":
            got = {r["doc_id"]: r["text"] for r in out.collect()}
            assert got.keys() <= {1, 2, 5, 7, None} and not {1, 2} <= got.keys() and "[SECRET]" in got[7]
        docs = out
    assert docs.where("NOT round_trip").count() == 0


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = materialize(stage(spark, docs, sf), "stage")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.schema.names == first.schema.names, name
        if name == "SimHash near-dedup":
            assert {r["doc_id"] for r in out.collect()} == brute_kept({r["doc_id"]: r["text"] for r in docs.collect()})
        if name == "secret scans":
            assert out.count() == docs.count() and secrets.scan(out).where("spans <> ''").count() == 0
        if name == "mixing to target weights":
            sizes, taken = by_source(docs), by_source(out)
            wanted = {r["source"]: r["target"] for r in mixing.mix(docs, mixing.quality_of(F.col("text"))).join(docs.select("doc_id", "source"), "doc_id").collect()}
            longest = docs.select(F.max(mixing.words(F.col("text")))).first()[0]
            assert math.isclose(sum(wanted.values()), 1.5 * sum(sizes.values()))
            assert all(abs(taken[s] - wanted[s]) <= longest for s in wanted)
        docs = out
    assert docs.where("NOT round_trip OR NOT same_as_sentencepiece").count() == 0
