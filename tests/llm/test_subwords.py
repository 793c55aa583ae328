"""The subword classifier: features by hand, scores by the plain formula, held-out accuracy, odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomwork.llm import queries, subwords

M64 = (1 << 64) - 1
BASE = int(subwords._BASE)
DOCS = "doc_id long, text string, label string, score double"


def scrambled(h):
    h = ((h ^ (h >> 32)) * 0x9E3779B97F4A7C15) & M64
    h = ((h ^ (h >> 29)) * 0xD6E8FEB86659FD93) & M64
    return h ^ (h >> 32)


def digits(text, up):
    """The number whose digits are the code points, the first one the lowest or, for n-grams, the highest."""
    h = 0
    for c in reversed(text) if up else text:
        h = (h * BASE + ord(c)) & M64
    return h


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]{1,1024}", text)
    shift = 64 - subwords.BUCKETS.bit_length() + 1
    hashes = [scrambled((digits(w, True) + len(w) * 0x1D) & M64) for w in words]
    out = list(hashes)
    out += [scrambled(((a ^ b) + 0x2F) & M64) for a, b in zip(hashes, hashes[1:])]
    for w in words:
        w = f" {w} "
        out += [scrambled((digits(w[i : i + n], False) + n * 0x3B) & M64) for n in subwords.GRAMS for i in range(len(w) - n + 1)]
    return Counter(h >> shift for h in out)


TEXTS = ["the cat sat", "", " \n\t", "a", "The THE the\x0b\x0cthe", "日本語 😀 x", "é" * 1500 + " end", "no break\u00a0space", "x " * 300]


def test_features_by_hand():
    for t in TEXTS:
        got = Counter()
        for run in subwords.text_runs(t):
            got.update(subwords.features([run])[0].tolist())
        assert got == plain(t), t
    runs = [" ".join(subwords.text_runs(t)) for t in TEXTS]
    bucket, where = subwords.features(runs)
    for i, t in enumerate(TEXTS):
        assert Counter(bucket[where == i].tolist()) == plain(t), t
    assert subwords.features([])[0].size == 0 and subwords.features([""])[0].size == 0


def test_scores_by_the_plain_formula(spark):
    rng = np.random.default_rng(3)
    model = subwords.Model(rng.integers(-(10**8), 10**8, subwords.BUCKETS), 0.25)
    texts = [*TEXTS, None, "word other " * 90_000]
    rows = [(i if i else None, t, "x", 0.0) for i, t in enumerate(texts)] + [(2**53 + 1, "the cat sat", "x", 0.0)]
    got = {r["doc_id"]: r["score"] for r in subwords.score(spark.createDataFrame(rows, DOCS), model).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, t, *_ in rows:
        if t and len(t) > 500_000:  # runs of words are taken apart, pairs across them are not
            found = Counter()
            for run in subwords.text_runs(t):
                found.update(plain(run))
        else:
            found = plain(t or "")
        n = sum(found.values())
        logit = 0.25 + sum(int(model.share[b]) * c for b, c in found.items()) / subwords.FIXED / max(1, n)
        assert math.isclose(got[i], 1 / (1 + math.exp(-logit)), rel_tol=1e-12)


def test_repeats_share_a_bucket():
    pair = scrambled(0x2F) >> (64 - subwords.BUCKETS.bit_length() + 1)
    assert plain("qq qq zz zz zz")[pair] >= 3


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in queries.op12_subwords(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    return rows, labels, spark.read.parquet(f"{sf}/documents.parquet").count()


def test_held_out_accuracy(scored):
    rows, labels, n = scored
    assert len(rows) == n
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [(rows[i]["predicted"], q) for i, q in labels.items() if rows[i]["held_out"] and q is not None]
    assert len(held) > 500
    for label in (0, 1):
        mine = [p == q for p, q in held if q == label]
        assert sum(mine) / len(mine) > 0.95, (label, sum(mine), len(mine))


def test_labels_of_the_held_out_fold_change_nothing(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", "quality AS label")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - label ELSE label END AS label")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(subwords.classify(docs, labels)) == key(subwords.classify(docs.repartition(5), turned))


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, 1), (1, 0), (2, None), (None, 1), (77, 0), (3, 0), (6, 0), (8, 1)]])
def test_odd_rows(spark, labels):
    rows = [(1, "good words here", "q", 0.5), (1, "good words here", "q", 0.5), (2, None, None, None), (3, "", None, None), (None, "no name", None, None), (6, "bad bad bad", None, None), (8, "other good words", None, None)]
    got = subwords.classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, label int")).collect()
    key = lambda i: (i is None, i or 0)
    assert sorted((r["doc_id"] for r in got), key=key) == sorted((r[0] for r in rows), key=key)
    assert all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1


def test_sample_is_bounded(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('w', id) AS text")
    labels = spark.range(400).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS label")
    small = subwords.train(docs, labels, subwords.F.lit(True), sample_docs=20)
    assert np.count_nonzero(small.share) <= 20 * 20
    assert subwords.train(docs.limit(0), labels, subwords.F.lit(True)).base == 0
