"""SimHash near-duplicate components with BK-trees.

A document's fingerprint has a bit set where more than half of its word-shingle hashes have it. Fingerprints that
differ in at most `radius` bits are linked. Cut into radius + 1 blocks of bits, two linked fingerprints agree in at
least one whole block, so each block value is a bucket and no link leaves its bucket. A bucket is cut into shards of
about SHARD fingerprints; each shard becomes one BK-tree (children keyed by their integer Hamming distance to the
parent), and the tree is sent to every chunk of queries of its own bucket. A search follows only the edges whose
distance is within the radius of the query's distance to the node. A search yields a spanning forest of its links, so
the number of links kept grows with the fingerprints and not with the pairs, and connected components join them.

Equal fingerprints are one node, so any number of exact copies costs one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import byte_pieces, connected_components, map_texts, materialize, partitions

#: Fingerprints of one BK-tree and of one chunk of queries, about.
SHARD = 2048
#: Bytes of a text whose words are taken apart at once.
PIECE = 1 << 18
#: Queries that walk a tree together.
WALK = 256


def fingerprint(text: str | None, words: int = 3) -> int:
    """Signed 64-bit SimHash of a text: A-Z lower-cased, ASCII white space apart, shingles of `words` words, XXH64 seed 42.

    Fewer words are one shingle; no words, or null, give 0.
    """
    carried, counts, n = [], np.zeros(64, np.int64), 0
    for piece in byte_pieces((text or "").encode("utf-8", "replace").lower(), PIECE):  # words are objects of one piece at a time
        tokens = carried + piece.split()
        if len(tokens) >= words:
            counts += _bit_counts(tokens, words)
            n += len(tokens) - words + 1
        carried = tokens[len(tokens) - words + 1 :] if len(tokens) >= words else tokens
    if not n:
        if not carried:
            return 0
        counts, n = _bit_counts([b" ".join(carried)], 1), 1
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def _bit_counts(tokens: list[bytes], words: int) -> np.ndarray:
    """How many shingle hashes have each of the 64 bits."""
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, digest = len(tokens) - words + 1, xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)
    h = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, n)
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long) of each row of docs; other columns are not read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_texts(rows, "text", lambda: lambda texts: {"fp": [fingerprint(x, words) for x in texts]}, "fp long", ["doc_id"])


class BKTree:
    """A BK-tree over distinct 64-bit codes in two arrays: node i + 1 hangs on the edge i, which is parent * 65 + distance."""

    def __init__(self, nodes: np.ndarray, edges: np.ndarray) -> None:
        self.nodes, self.edges = nodes, edges

    @classmethod
    def build(cls, codes: np.ndarray) -> BKTree:
        nodes, edges = [codes[:1]], []
        pending, parent, placed = codes[1:], np.zeros(max(0, len(codes) - 1), np.int64), 1
        parents = codes[:1]
        base = 0
        while len(pending):
            key = parent * 65 + np.bitwise_count(pending ^ parents[parent - base])
            order = np.argsort(key, kind="stable")
            key, pending = key[order], pending[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            group = np.cumsum(first) - 1
            nodes.append(pending[first])
            edges.append(key[first])
            parents, base = pending[first], placed
            pending, parent = pending[~first], placed + group[~first]
            placed += len(parents)
        return cls(np.concatenate(nodes), np.concatenate(edges).astype(np.int64) if edges else np.zeros(0, np.int64))

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (query, node) of every pair within the radius."""
        found = list(self.walks(queries, radius))
        return np.concatenate([q for q, _ in found]), np.concatenate([n for _, n in found])

    def walks(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """search() for WALK queries after the other, so that the pairs of a crowded tree are never held together."""
        for at in range(0, len(queries), WALK):
            part = queries[at : at + WALK]
            found_q, found_n = [], []
            q, node = np.arange(len(part)), np.zeros(len(part), np.int64)
            while len(q):
                d = np.bitwise_count(part[q] ^ self.nodes[node]).astype(np.int64)
                hit = d <= radius
                found_q.append(q[hit] + at)
                found_n.append(node[hit])
                lo = np.searchsorted(self.edges, node * 65 + np.maximum(d - radius, 1))
                n = np.searchsorted(self.edges, node * 65 + np.minimum(d + radius, 64), "right") - lo
                q = np.repeat(q, n)
                node = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum()) + 1
            yield np.concatenate(found_q), np.concatenate(found_n)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position in each position's component, over links a-b among n positions."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _plant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        trees = [BKTree.build(np.asarray(x, np.int64).view(np.uint64)) for x in batch["codes"]]
        yield batch[["block", "value", "shard"]].assign(nodes=[t.nodes.view(np.int64) for t in trees], edges=[t.edges for t in trees])


def _links(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for nodes, edges, chunk in zip(batch["nodes"], batch["edges"], batch["chunk"], strict=True):
                tree = BKTree(np.asarray(nodes, np.int64).view(np.uint64), np.asarray(edges, np.int64))
                own = chunk is None
                queries = tree.nodes if own else np.asarray(chunk, np.int64).view(np.uint64)
                codes = tree.nodes if own else np.concatenate([tree.nodes, queries])
                label = np.arange(len(codes))
                for q, node in tree.walks(queries, radius):
                    a, b = label[node], label[q if own else q + len(tree.nodes)]
                    if (a != b).any():
                        label = _forest(len(codes), a[a != b], b[a != b])[label]
                linked = label != np.arange(len(codes))
                yield pd.DataFrame({"a": codes[linked].view(np.int64), "b": codes[label[linked]].view(np.int64)})

    return run


def near_links(codes: DataFrame, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between distinct codes (fp long) that connect exactly what pairs within `radius` bits connect."""
    width = [64 // (radius + 1) + (i < 64 % (radius + 1)) for i in range(radius + 1)]
    offset = [sum(width[:i]) for i in range(radius + 1)]
    mask = [(1 << w) - 1 for w in width]
    rows = codes.select("fp", F.posexplode(F.array(*(F.shiftright("fp", o).bitwiseAND(F.lit(m)) for o, m in zip(offset, mask, strict=True)))).alias("block", "value"))
    # only block values shared by more than a shard: no more rows than there are block values, at most sum of 2 ** width
    crowded = rows.groupBy("block", "value").count().where(F.col("count") > shard)
    crowded = crowded.select("block", "value", F.ceil(F.col("count") / shard).cast("int").alias("shards"))
    rows = rows.join(F.broadcast(crowded), ["block", "value"], "left")
    rows = rows.withColumn("shard", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("shards")), F.lit(0)).cast("int"))
    groups = rows.groupBy("block", "value", "shard").agg(F.collect_list("fp").alias("codes"), F.first("shards").alias("shards"))
    groups = groups.where("size(codes) > 1 OR shards IS NOT NULL").select("block", "value", "shard", "codes")
    trees = materialize(groups.mapInPandas(_plant, "block int, value long, shard int, nodes array<long>, edges array<long>"), "bktrees")
    chunks = trees.select("block", "value", F.col("shard").alias("chunk_shard"), F.col("nodes").alias("chunk"))
    several = trees.groupBy("block", "value").agg(F.max("shard").alias("last")).where("last > 0").select("block", "value")
    crossed = trees.join(F.broadcast(several), ["block", "value"], "left_semi").join(chunks.where("chunk_shard > 0"), ["block", "value"]).where("shard < chunk_shard")
    crossed = crossed.select("nodes", "edges", "chunk").repartition(partitions(codes.sparkSession))
    return trees.select("nodes", "edges", F.lit(None).cast("array<long>").alias("chunk")).union(crossed).mapInPandas(_links(radius), "a long, b long")


def components(docs: DataFrame, words: int = 3, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links of at most `radius` differing bits reach. Null or empty texts have
    fingerprint zero and link like any other. A null doc_id is kept and is never a component_id unless its whole
    component has none (then null). Repeated rows each give a row; an empty table gives none; other columns are ignored.
    """
    prints = materialize(fingerprints(docs, words), "fingerprints")
    codes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "codes")
    labels = connected_components(materialize(near_links(codes, radius, shard), "links"))
    labelled = materialize(codes.join(labels, codes.fp == labels.node).select("fp", "component", "first_doc"), "labelled")
    roots = materialize(labelled.groupBy("component").agg(F.min("first_doc").alias("component_id")), "components")
    joined = labelled.join(roots, "component").select(F.col("fp").alias("linked_fp"), "component_id")
    classes = materialize(codes.join(joined, codes.fp == F.col("linked_fp"), "left").select(F.col("fp").alias("class_fp"), F.coalesce("component_id", "first_doc").alias("component_id")), "classes")
    out = prints.join(classes, prints.fp == classes.class_fp)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
