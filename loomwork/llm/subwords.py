"""Quality classifier: supervised subword embeddings.

A text's features are its words, the character n-grams of each word with its edges marked, and the pairs of words that follow one
another, each hashed to a bucket. A pair is hashed by the exclusive or of its words, so that all immediate repeats of a word share
one bucket. Every bucket has a learned vector; a document is the average of its features' vectors, and a softmax over labels
follows. Vectors and softmax are learned together by stochastic gradient descent in numpy.

Learning takes a bounded sample: the SAMPLE_DOCS labelled rows with the smallest hash of their doc_id, of these as many as hold
SAMPLE_FEATURES distinct features together; it is shuffled by hash, so memory and time of learning do not grow with the table.
Scoring takes all features of whole texts. As averages and the softmax's logits are linear, a feature counts through its bucket's
share of the difference of the two logits; shares are fixed-point numbers, so a score does not depend on batches.

Rules: a null text is empty; a text without words has the score that the softmax gives an empty average. A row without a label, or
with a null doc_id, is scored and not learned from; a doc_id with several labels counts as their mean, 1 from a half. Without two
classes to learn from, the score is their observed share, or 0.5 without any. Words over WORD code points count as several words of
that length. Columns besides doc_id and text are not read. Repeated rows are scored each. No documents give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import drop_table, materialize, mixed, text_batches

BUCKETS = 1 << 16
SIZE = 16
GRAMS = (3, 4, 5)
#: Labelled documents to learn from at most, and their distinct features together at most.
SAMPLE_DOCS, SAMPLE_FEATURES = 6_000, 1 << 23
EPOCHS, RATE = 6, 20.0
#: Code points of a word at most, and words of a text that are taken at once.
WORD, RUN = 1024, 1 << 16
#: Score from which the prediction is 1.
THRESHOLD = 0.3
#: A share of the logits in fixed point.
FIXED = 1 << 24
_PIECE = re.compile(r"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]{1,%d}){1,%d}" % (WORD, RUN))
_LONG = re.compile(r"([^\x20\x09-\x0D]{%d})(?=[^\x20\x09-\x0D])" % WORD)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_KINDS = {"word": np.uint64(0x1D), "pair": np.uint64(0x2F), "gram": np.uint64(0x3B)}


def text_runs(text: str) -> Iterator[str]:
    """A text as runs of words of bounded length; words that are too long are cut apart."""
    for m in _PIECE.finditer(text):
        yield _LONG.sub(r"\1 ", m.group())


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, which of the texts) of all features of texts, as text_runs() gives them, in no particular order. No feature crosses texts."""
    joined = " " + "  ".join(texts) + " "
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    white = (code == 32) | ((code >= 9) & (code <= 13))
    code[white] = 32
    ends = np.cumsum([1] + [len(t) + 2 for t in texts])[:-1]  # where each text starts
    edge = np.flatnonzero(np.diff(white.view(np.int8)))
    starts, stops = edge[::2] + 1, edge[1::2] + 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a word's hash is that of its code points as digits, whatever its place
    back = np.uint64(pow(int(_BASE), -1, 1 << 64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * _powers(len(code), _BASE), dtype=np.uint64)])
    word = mixed((sums[stops] - sums[starts]) * _powers(len(code), back)[starts] + (stops - starts).astype(np.uint64) * _KINDS["word"])
    home = np.searchsorted(ends, starts, "right") - 1
    found, where = [word], [home]
    together = home[1:] == home[:-1]
    found.append(mixed((word[1:] ^ word[:-1])[together] + _KINDS["pair"]))
    where.append(home[1:][together])
    # n-grams: white space at their first or last place only, as a word's edge
    inner = np.concatenate([np.zeros(1, np.int32), np.cumsum(white, dtype=np.int32)])
    gram = code.copy()
    at = 1
    for n in GRAMS:
        while at < n:
            gram = gram[: len(code) - at] * _BASE + code[at:]
            at += 1
        begin = np.flatnonzero((inner[n - 1 : len(inner) - 1][: len(gram)] - inner[1 : len(gram) + 1]) == 0)
        found.append(mixed(gram[begin] + np.uint64(n) * _KINDS["gram"]))
        # an n-gram that starts with the edge before a word belongs to that word's text
        where.append(np.searchsorted(ends, begin + white[begin], "right") - 1)
    return (np.concatenate(found) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), np.concatenate(where)


@dataclass
class Model:
    """share: of each bucket in the difference of the logits of label 1 and 0, in fixed point; base: that of an empty average."""

    share: np.ndarray
    base: float

    def score(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The probability of label 1 from the sum of shares and the number of features."""
        logit = self.base + total / FIXED / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of shares, and number of features, of each whole text."""
        total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for runs, owner in _bundles(texts):
            bucket, where = features(runs)
            total += np.bincount(owner[where], self.share[bucket], len(texts))
            n += np.bincount(owner[where], minlength=len(texts))
        return total, n


def _bundles(texts: list[str | None], most: int = 1 << 19) -> Iterator[tuple[list[str], np.ndarray]]:
    """Runs of the texts, about `most` characters at a time, and which text each is of."""
    runs, owner, size = [], [], 0
    for i, text in enumerate(texts):
        for run in text_runs(text or ""):
            runs.append(run)
            owner.append(i)
            size += len(run)
            if size >= most:
                yield runs, np.array(owner)
                runs, owner, size = [], [], 0
    if runs:
        yield runs, np.array(owner)


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 1) -> Model:
    """The model of documents (buckets, their counts, label 0 or 1), one step of gradient descent after each, the rate falling to zero."""
    labels = [y for _, _, y in rows]
    if len(set(labels)) < 2:
        part = (sum(labels) + 0.5) / (len(labels) + 1)
        return Model(np.zeros(BUCKETS, np.int64), float(np.log(part / (1 - part))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE))
    weights, bias = np.zeros((2, SIZE)), np.zeros(2)
    steps, step = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)).tolist():
            bucket, count, y = rows[i]
            rate = 1 - step / steps
            step += 1
            part = count / max(1, count.sum())
            mean = part @ vectors[bucket]
            logit = weights @ mean + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            back = weights.T @ p
            weights -= rate * 0.5 * np.outer(p, mean)
            bias -= rate * 0.05 * p
            vectors[bucket] -= rate * RATE * part[:, None] * back
    seen = np.zeros(BUCKETS, bool)
    for bucket, *_ in rows:
        seen[bucket] = True
    vectors[~seen] = 0  # what nothing was learned of says nothing
    apart = weights[1] - weights[0]
    return Model(np.rint(vectors @ apart * FIXED).astype(np.int64), float(bias[1] - bias[0]))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets and counts in place of texts."""
    for batch in batches:
        buckets, counts = [], []
        for text in batch.column(2):
            seen = np.zeros(BUCKETS, np.int32)
            for run in text_runs(text.as_py() or ""):
                seen += np.bincount(features([run])[0], minlength=BUCKETS).astype(np.int32)
            buckets.append(np.flatnonzero(seen).astype(np.int32))
            counts.append(seen[buckets[-1]])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(buckets, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["place", "y", "buckets", "counts"])


def train(documents: DataFrame, labels: DataFrame, learned: Column, sample_docs: int = SAMPLE_DOCS, sample_features: int = SAMPLE_FEATURES) -> Model:
    """The model of labels (doc_id, label 0 or 1) on documents for which `learned`, a condition on doc_id, holds."""
    spark = documents.sparkSession
    text_batches(spark)
    mean = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & learned).groupBy("doc_id").agg(F.avg("label").alias("mean"))
    there = mean.join(documents.select("doc_id"), "doc_id", "left_semi")
    mark = F.xxhash64(F.col("doc_id"))
    few = there.orderBy(mark, "doc_id").limit(sample_docs).select("doc_id", (F.col("mean") >= 0.5).cast("int").alias("y"))
    few = materialize(few, "sample")  # sample_docs small rows
    # rows that repeat a doc_id are as many examples, within the same bound
    examples = documents.join(F.broadcast(few), "doc_id").select(mark.alias("place"), "y", "text").orderBy("place", F.xxhash64("text")).limit(sample_docs)
    bags = materialize(examples.mapInArrow(_bags, "place long, y int, buckets array<int>, counts array<int>"), "bags")
    sizes, held, end = bags.groupBy("place").agg(F.sum(F.size("buckets")).alias("n")).orderBy("place").collect(), 0, None  # sample_docs numbers at most
    for r in sizes:
        held += r["n"]
        if held > sample_features:
            break
        end = r["place"]
    if end is None:
        return learn([])
    found = bags.where(F.col("place") <= end).orderBy("place", "y", F.xxhash64("buckets", "counts")).toArrow()
    rows = [(b.values.to_numpy(), c.values.to_numpy(), y.as_py()) for batch in found.to_batches() for y, b, c in zip(*batch.columns[1:], strict=True)]
    drop_table(few)
    drop_table(bags)
    return learn(rows)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    text_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.score(*shared.value.sums(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def held_out(fold: int = 0, folds: int = 5) -> Column:
    """Whether a row is kept from learning: crc32 of doc_id as text; null ids are not learned from either."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(True))


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from THRESHOLD on) of every document, learned from labels (doc_id, label) that are not held out."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs, labels, ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
