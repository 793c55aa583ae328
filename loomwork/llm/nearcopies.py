"""Near copies by the Jaccard similarity of word shingles, exactly: candidates from two sources, then the sets decide.

Two documents are linked if their sets of five-word shingles have a Jaccard similarity of at least 4/5. Documents of one
set are one class. Candidates between classes come from SimHash links (simhash.near_links), which join most of a group at
little cost, and from an exact key: with the shingles of every set in one order, two sets that similar share a shingle
among the first n - ceil(4n/5) + 1 of each. Pairs of that key in different components of the links found so far are
candidates if what they share there, and what their sketches differ in, leave the similarity possible. Each candidate's
two sets are compared in full.

The order puts shingles that a sample finds common last, so that common passages are keys of few texts. It changes the
cost only: the key holds for any order. Sets are of 64-bit hashes, and a class is known by a 64-bit hash of its set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import connected_components, drop_table, give_back, map_texts, materialize, mixed, on_ids, text_batches, text_pieces, word_hashes
from loomwork.llm.simhash import near_links

WORDS = 5
#: Texts of the sample that finds common shingles, the times one is seen in it, and the most of them that are sent out.
SAMPLE, SEEN, COMMON = 10_000, 3, 100_000
SHIFT = 1 << 31
#: Rounds of pairs with centres, then of neighbours, before the components that are left are paired in full; they change the cost only.
ROUNDS = 1
#: Bits of a set's sketch, and the numbers that hold them; more rule out pairs of longer texts.
SKETCH = 1024
LONGS = SKETCH // 64


def shingle_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The hashes of each text's five-word shingles in order, repeats included, words as in simhash.fingerprint; fewer words are one shingle."""
    for at, to in text_pieces(texts):
        parts = [(t or "").encode("utf-8", "replace") for t in texts[at:to]]
        each, starts = word_hashes(b"\n".join(parts))
        bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]))
        whole = _combined(each, WORDS)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            yield whole[lo : hi - WORDS + 1] if hi - lo >= WORDS else _combined(each[lo:hi], hi - lo)


def _combined(each: np.ndarray, words: int) -> np.ndarray:
    out = np.full(max(0, len(each) - words + 1) if words else 0, words, np.uint64)
    for k in range(words):
        out = mixed(out ^ each[k : k + len(out)])
    return out


def shingles(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    return map(np.unique, shingle_hashes(texts))


def simhash(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of shingle hashes: a bit is set where more than half have it; none give 0."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory for very long texts
        counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least 4/5."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _inside(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A mark for each that is in a sorted array."""
    if not len(common):
        return np.zeros(len(found), bool)
    return common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found


def bins(found: np.ndarray) -> bytes:
    """How many hashes of a set begin with each byte, as bytes; 255 stands for that many or more."""
    return np.minimum(np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def sketch(found: np.ndarray) -> np.ndarray:
    """Whether each of SKETCH parts of the hash space holds an odd number of a set's hashes, as bits in signed numbers.

    A part in which two sketches differ holds a hash that only one of the two sets has.
    """
    part = (found >> np.uint64(65 - SKETCH.bit_length())).astype(np.int64)
    return np.packbits(np.bincount(part, minlength=SKETCH).astype(np.uint8) & 1, bitorder="little").view(np.int64)


def most_shared(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The most hashes that sets of these bins can share: no bin shares more than either set has there."""
    low = np.minimum(*(np.frombuffer(b"".join(x), np.uint8).reshape(-1, 256) for x in (a, b))).astype(np.int64)
    return np.where((low == 255).any(axis=1), 1 << 40, low.sum(axis=1))


def _node(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 42)).view(np.int64))


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that are common in a sample of docs."""
    every = max(1, docs.count() // SAMPLE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *shingles(batch["text"].tolist())]), return_counts=True)
            yield pd.DataFrame({"h": seen.view(np.int64), "n": n})

    rows = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text").mapInPandas(run, "h long, n long")
    counts = rows.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN).orderBy(F.desc("n"), "h").limit(COMMON)
    return np.sort(np.array([r["h"] for r in counts.collect()], np.int64).view(np.uint64))


def _prints(docs: DataFrame, common: np.ndarray) -> DataFrame:
    def values(texts: list[str | None]) -> dict:
        out = []
        for hashes in shingle_hashes(texts):
            found = np.unique(hashes)
            late = _inside(found, common)
            first = np.concatenate([found[~late], found[late]])[: len(found) - (4 * len(found) + 4) // 5 + 1] if len(found) else found
            out.append((simhash(hashes), _node(found), len(found), bins(found), sketch(found), first.view(np.int64)))
        return {name: [x[k] for x in out] for k, name in enumerate(("fp", "node", "n", "bins", "sketch", "first"))}

    return map_texts(docs, "text", lambda: values, "fp long, node long, n int, bins binary, sketch array<long>, first array<long>", ["doc_id"])


def _simhash_pairs(classes: DataFrame, radius: int) -> DataFrame:
    """Pairs of classes that SimHash links: within the radius, or of one fingerprint."""
    codes = materialize(classes.groupBy("fp").agg(F.min("node").alias("head")), "codes")
    links = near_links(codes, radius)
    a, b = codes.select(F.col("fp").alias("a"), F.col("head").alias("x")), codes.select(F.col("fp").alias("b"), F.col("head").alias("y"))
    far = links.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return far.union(classes.join(codes, "fp").where("node <> head").select("head", "node"))


def _shared_keys(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, c, k, low, high) of the keys that classes in different components c share, keys that the same classes have as one.

    A passage that some texts share gives them tens of keys, all of the same classes: such a set of classes is a key once, by a hash
    of its nodes, with the number k of keys in it and the places of its first and last, so that a pair meets once for each set and
    not for each key.
    """
    named = on_ids(classes.select("node", "n", "first"), labels.select("node", "component"), "node", "left")
    # size and place in one number: these are the rows that there are most of
    keys = named.select("node", F.coalesce("component", "node").alias("c"), "n", F.posexplode("first").alias("at", "key"))
    keys = keys.select("key", "node", "c", (F.col("n").cast("long") * SHIFT + F.col("at")).alias("n_at"))
    same = Window.partitionBy("key")
    rows = _parted(keys, *(F.bit_xor(F.xxhash64(F.lit(seed), "node")).over(same).alias(f"set_{seed}") for seed in (1, 2)))
    sets = rows.groupBy(F.xxhash64("set_1", "set_2").alias("key"), "node").agg(F.first("c").alias("c"), F.count(F.lit(1)).alias("k"), F.min("n_at").alias("low"), F.max("n_at").alias("high"))
    return materialize(sets, "shared")


def _parted(keys: DataFrame, *more: Column) -> DataFrame:
    """keys, with more columns, without those that one component alone has."""
    same = Window.partitionBy("key")
    rows = keys.select("*", *more, F.min("c").over(same).alias("least_c"), F.max("c").over(same).alias("most_c")).where("least_c <> most_c")
    return rows.drop("least_c", "most_c")


def _relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of _shared_keys() after more links are known; rows itself is deleted."""
    now = on_ids(rows.drop("c"), labels.select("node", "component"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"), "k", "low", "high")
    out = materialize(_parted(now), "shared")
    drop_table(rows)
    return out


def _neighbour_pairs(rows: DataFrame, seed: int) -> DataFrame:
    """Of the classes of each key, in an order by hash, the neighbours that are in different components.

    No more pairs than rows, which join most of a large group before its remaining components are paired in full.
    """
    order = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), "node"), "node")
    met = rows.select("node", "c", F.lag("node").over(order).alias("other"), F.lag("c").over(order).alias("other_c"))
    return met.where("c <> other_c").select(F.col("other").alias("a"), F.col("node").alias("b"))


def _centre_pairs(rows: DataFrame) -> DataFrame:
    """Each class with the most central class of its key, where the two are in different components.

    Most copies of a text are similar to the text itself, though not to each other. It has no edits of its own, so its
    keys are those that most classes share: the class whose keys have the most rows stands in the centre.
    """
    weights = rows.select("node", (F.col("k") * F.count(F.lit(1)).over(Window.partitionBy("key"))).alias("rows")).groupBy("node").agg(F.sum("rows").alias("weight"))
    weighed = on_ids(rows.select("key", "node", "c"), materialize(weights, "weights"), "node", "inner")
    centre = F.max(F.struct("weight", "node", "c")).over(Window.partitionBy("key"))
    met = weighed.select("node", "c", centre.alias("centre")).where("c <> centre.c")
    return met.select(F.col("centre.node").alias("a"), F.col("node").alias("b"))


def _key_pairs(rows: DataFrame, sketches: DataFrame | None = None) -> DataFrame:
    """Pairs of classes in different components that share keys enough to be similar, and whose sketches (node, sketch) leave it possible.

    The sets of a class stand in one order, those of most classes first. A pair is made where what stands before differs: else it was
    made there. All that the two share comes from the first such place on, so that each has keys enough left there. Of a passage that
    a whole group shares, or copies that are just too far from each other, most pairs end at the sketches: sets of that likeness differ
    in a ninth of what they hold together at most, and in no fewer hashes than their sketches in bits.
    """
    order = Window.partitionBy("node").orderBy(F.desc("classes"), "key")
    rest = F.sum("k").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    placed = rows.select("*", F.count(F.lit(1)).over(Window.partitionBy("key")).alias("classes"))
    placed = placed.select("key", "node", "c", "low", "high", rest.alias("rest"), F.lag("key").over(order).alias("before"))
    bits = [f"bits_{k}" for k in range(LONGS)] if sketches is not None else []
    if bits:
        placed = placed.join(sketches.select("node", *(F.col("sketch")[k].alias(b) for k, b in enumerate(bits))), "node")
    x, y = (placed.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "c", "low", "high", "rest", "before", *bits))) for side in "ab")
    n = {side: F.floor(F.col(f"low_{side}") / SHIFT) for side in "ab"}
    at = {(end, side): F.col(f"{end}_{side}") % SHIFT for end in ("low", "high") for side in "ab"}
    # what is before a shared key, and it with what is after: no more is shared than either set has there
    room = [9 * (F.least(at[end, "a"], at[end, "b"]) + F.least(n["a"] - at[end, "a"], n["b"] - at[end, "b"])) >= 4 * (n["a"] + n["b"]) for end in ("low", "high")]
    # shared are keys of both, and what follows the keys of that class whose keys end first
    after = F.greatest(*(F.ceil(4 * n[side] / 5) - 1 for side in "ab"))
    enough = 9 * (F.least("rest_a", "rest_b") + after) >= 4 * (n["a"] + n["b"])
    alike = (5 * F.least(n["a"], n["b"]) >= 4 * F.greatest(n["a"], n["b"])) & room[0] & room[1] & enough
    apart = sum((F.bit_count(F.col(f"{b}_a").bitwiseXOR(F.col(f"{b}_b"))) for b in bits), F.lit(0))
    alike &= 9 * apart <= n["a"] + n["b"]
    new = F.col("before_a").isNull() | F.col("before_b").isNull() | (F.col("before_a") != F.col("before_b"))
    met = x.join(y, (x["key"] == y["key"]) & (F.col("node_a") < F.col("node_b")) & (F.col("c_a") != F.col("c_b")) & new & alike)
    pairs = materialize(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "key_pairs")
    drop_table(rows)
    return pairs


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar."""
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs")

    def possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            most = most_shared(batch["x"].tolist(), batch["y"].tolist())
            yield batch.loc[(9 * most >= 4 * batch["n"]).to_numpy(), ["a", "b"]]
        give_back()

    # counts by the first byte rule most pairs out that share a passage only, before any text moves
    x, y = (classes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("bins").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    met = pairs.join(x, "a").join(y, "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "x", "y")
    met = materialize(met.mapInPandas(possible, "a long, b long"), "possible")
    drop_table(pairs)
    pairs = met
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ends = classes.join(ends, "node", "left_semi").select(F.col("first_doc").alias("doc_id"), "node")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            same = [similar(x, y) for x, y in zip(shingles(batch["x"].tolist()), shingles(batch["y"].tolist()), strict=True)]
            yield batch.loc[np.array(same, bool), ["a", "b"]]
        give_back()

    # texts are shorter than their sets, so they travel and the sets are made where the ends meet
    found = materialize(on_ids(docs.select("doc_id", "text"), materialize(ends, "ends"), "doc_id", "inner").select("node", "text"), "texts")
    x, y = found.select(F.col("node").alias("a"), F.col("text").alias("x")), found.select(F.col("node").alias("b"), F.col("text").alias("y"))
    out = materialize(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(compare, "a long, b long"), "similar")
    drop_table(found)
    drop_table(pairs)
    return out


def keep_first(docs: DataFrame, radius: int = 6) -> DataFrame:
    """docs without all but the smallest doc_id of each group that links of similarity 4/5 and more connect; the columns stay.

    radius is that of the SimHash links and changes the cost only. Null texts are empty, and texts without words are
    copies of each other. Of rows with one doc_id only one stays, that with the smallest text, and of equal texts any;
    rows with a null doc_id all stay and link nothing. An empty table gives none.
    """
    text_batches(docs.sparkSession)
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        one = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by(whole, F.coalesce("text", F.lit(""))).alias("_one")).select("_one.*")
        docs = materialize(one.union(docs.where("doc_id IS NULL")), "one_each")
    named = docs.where("doc_id IS NOT NULL")
    full = materialize(_prints(named, common_shingles(named)), "prints")
    prints = materialize(full.select("doc_id", "node"), "nodes")
    classes = materialize(full.groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bins").alias("bins"), F.first("sketch").alias("sketch"), F.first("first").alias("first")), "classes")
    drop_table(full)
    near = _verified(_simhash_pairs(classes, radius), named, classes)
    rows = _shared_keys(classes, connected_components(near))
    for k in range(ROUNDS):
        pairs = _neighbour_pairs(rows, k) if k else _centre_pairs(rows)
        near = materialize(near.union(_verified(pairs, named, classes)), "near")
        rows = _relabelled(rows, connected_components(near))
    more = _verified(_key_pairs(rows, classes), named, classes)
    labels = connected_components(near.union(more)).withColumnRenamed("node", "labelled")
    labelled = materialize(classes.select("node", "first_doc").join(labels, F.col("node") == F.col("labelled"), "left").select("node", "first_doc", F.coalesce("component", "node").alias("component")), "labelled")
    drop_table(classes)
    roots = labelled.groupBy("component").agg(F.min("first_doc").alias("kept"))
    kept = materialize(labelled.join(roots, "component").select("node", "kept"), "kept")
    copies = materialize(prints.select("doc_id", "node").join(kept, "node").where("doc_id <> kept").select("doc_id"), "copies")
    return on_ids(docs, copies, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
