"""The near-duplicate stage against brute force over five-word shingles."""

import random

import corpus_pipeline
import numpy as np

from loomwork.llm import nearcopies


def five(text):
    w = (text or "").encode("utf-8", "replace").lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_kept(texts):
    """The ids that stay: of each component of links of 0.8 and more the smallest."""
    sets = {i: five(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in sets.items():
        for x in s or {b""}:
            where.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j in {j for x in (s or {b""}) for j in where[x] if j < i}:
            if 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in root if find(i) == i}


def stage_kept(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, None).collect()}


def edited():
    """Originals and copies with scattered edits: some above 0.8, some below; and texts that share a long passage."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts, passage = {}, [word() for _ in range(60)]
    for k in range(60):
        base = [word() for _ in range(rng.choice((20, 80, 300)))]
        texts[10 * k + 1] = " ".join(base)
        for c in range(3):
            copy = list(base)
            for at in range(7, len(copy), rng.choice((40, 47, 55, 90))):
                copy[at] = word()
            texts[10 * k + 2 + c] = " ".join(copy)
        texts[10 * k + 9] = " ".join(passage + [word() for _ in range(12 + k % 30)])
    return texts | {9001: "", 9002: None, 9003: "two words", 9004: "Two  Words", 9005: "two words more"}


def test_finds_every_near_copy(spark):
    texts = edited()
    want = brute_kept(texts)
    got = stage_kept(spark, texts)
    assert not got - want, "near copies that stay"


def test_drops_only_near_copies(spark):
    texts = edited()
    want = brute_kept(texts)
    got = stage_kept(spark, texts)
    assert not want - got, "documents dropped without a near copy"


def test_documents(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert stage_kept(spark, texts) == brute_kept(texts)


def test_bins_never_rule_out_what_is_shared():
    rng = np.random.default_rng(3)
    for n in (0, 1, 50, 100_000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) // 2], rng.integers(0, 2**64, n // 2, dtype=np.uint64)]))
        most = nearcopies.most_shared([nearcopies.bins(a)], [nearcopies.bins(b)])[0]
        assert most >= len(np.intersect1d(a, b))
    assert nearcopies.most_shared([nearcopies.bins(a[:400])], [nearcopies.bins(b[-400:])])[0] < 400


def test_shared_passage_is_one_key(spark):
    """Classes that share 20 keys have them as one, and each pair of them is proposed."""
    rows = [(node, 100, [*range(20), 1000 + node]) for node in range(30)] + [(99, 100, [*range(5, 20), 7])]
    classes = spark.createDataFrame([(a, n, sorted(set(first))) for a, n, first in rows], "node long, n int, first array<long>")
    shared = nearcopies._shared_keys(classes, spark.createDataFrame([], "node long, component long"))
    found = sorted((r["node"], r["k"]) for r in shared.collect())
    assert found == sorted([(node, k) for node in range(30) for k in (5, 15)] + [(99, 15)])
    pairs = {(r["a"], r["b"]) for r in nearcopies._key_pairs(shared).collect()}
    assert pairs == {(a, b) for a in range(30) for b in [*range(a + 1, 30), 99]}


def test_sketches_never_differ_in_more_than_the_sets():
    rng = np.random.default_rng(5)
    for n, other in ((0, 0), (0, 3), (50, 10), (900, 200), (20_000, 4_000)):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[other:], rng.integers(0, 2**64, other, dtype=np.uint64)]))
        bits = int(np.bitwise_count(nearcopies.sketch(a) ^ nearcopies.sketch(b)).sum())
        assert bits <= len(np.setxor1d(a, b)) and (bits > 0) == (other > 0)


def test_copies_just_too_far_are_not_all_paired(spark, monkeypatch):
    """Copies of one text that differ a little too much from each other: pairs to compare grow with them, not with their square."""
    rng = random.Random(11)
    base, places = [f"word{k}" for k in range(300)], range(8, 292, 6)
    texts = {}
    for i in range(80):  # the first 40 are linked, the others to none
        copy = list(base)
        for at in rng.sample(places[:15], 3) if i < 40 else rng.sample(places[15:], 5):
            copy[at] = f"edit{i}at{at}"
        texts[i] = " ".join(copy)
    made, pair = [], nearcopies._key_pairs

    def counted(*args):
        made.append(pair(*args))
        return made[-1]

    monkeypatch.setattr(nearcopies, "_key_pairs", counted)
    monkeypatch.setattr(nearcopies, "drop_table", lambda df: None)
    assert stage_kept(spark, texts) == brute_kept(texts)
    assert made[0].count() <= 5 * len(texts)
