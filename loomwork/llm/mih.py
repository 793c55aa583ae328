"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Vectors are centred and turned by rotations learned on a bounded sample (principal axes, then iterative quantisation);
the signs are the code. Codes are cut into substrings of 64 bits, and a shard of the index keeps, for each substring, the
values that occur and the rows of each. Codes within radius R of a query differ from it by at most floor(R / substrings)
bits in some substring (pigeonhole), so probing the values within that distance in every substring finds all of them; the
codes found are filtered by the whole distance and the rest is ranked by the distance of the original vectors.

The radius is the one within which HELD of the sample's true neighbours lie. Queries that find fewer than k rows are
searched again with a radius that holds every code, which is exact.

Substrings are long because neighbours may differ in two bits of five: substrings of 8 or 16 bits within such a distance
hold nearly every value, while those of 64 bits are within it for about one code in six. There are more values within the
distance than rows, so a probe compares the values that occur instead of making up all that could.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import materialize, text_batches

#: Vectors that the rotations are learned from, and bits of a code, about (whole substrings).
SAMPLE, BITS = 8192, 256
#: Share of the sample's true neighbours that the radius holds.
HELD = 0.94
#: Rows of one shard of the index, and queries of one block, about.
SHARD, BLOCK = 8192, 1024
SUB = 64


class Codes:
    """The learned map from vectors to packed binary codes."""

    def __init__(self, mean: np.ndarray, turns: np.ndarray, radius: int) -> None:
        self.mean, self.turns, self.radius = mean, turns, radius

    @property
    def bits(self) -> int:
        return self.turns.shape[1]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Rows of codes, a 64-bit word for each substring."""
        return np.packbits((x - self.mean) @ self.turns > 0, axis=1).view(np.uint64)

    @classmethod
    def learn(cls, x: np.ndarray, bits: int = BITS, k: int = 10, held: float = HELD, seed: int = 0) -> Codes:
        """x: the sample. Rotations are fitted so that the sign loses least; the radius is measured on the sample itself."""
        rng = np.random.default_rng(seed)
        dim = x.shape[1]
        mean = x.mean(axis=0)
        bits = max(SUB, bits // SUB * SUB)
        axes = np.linalg.svd(x - mean, full_matrices=False)[2].T[:, :bits] if len(x) >= dim else np.eye(dim)[:, :bits]
        flat, wide = (x - mean) @ axes, axes.shape[1]
        turns = []
        for _ in range(ceil(bits / wide)):
            turn = np.linalg.qr(rng.normal(size=(wide, wide)))[0]
            for _ in range(20):
                u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
                turn = (u @ v).T
            turns.append(axes @ turn)
        out = cls(mean, np.concatenate(turns, axis=1)[:, :bits], bits)
        codes = out.encode(x)
        probe = x[: min(512, len(x))]
        d = ((probe**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * probe @ x.T)
        d[np.arange(len(probe)), np.arange(len(probe))] = np.inf
        near = np.argsort(d, axis=1)[:, : min(k, len(x) - 1)]
        if near.size:
            h = np.bitwise_count(codes[: len(probe), None] ^ codes[near]).sum(axis=2)
            out.radius = int(np.quantile(h, held, method="higher"))
        return out


class Index:
    """One shard: for each substring the values that occur, and the rows of each value."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.tables = []
        for column in codes.T:
            rows = np.argsort(column, kind="stable")
            values, starts = np.unique(column[rows], return_index=True)
            self.tables.append((values, rows, np.append(starts, len(rows))))

    def candidates(self, code: np.ndarray, radius: int) -> np.ndarray:
        """A mark for each row that the probes of the substrings find."""
        each, left = divmod(radius, len(code))
        found = np.zeros(len(self.codes), bool)
        for j, (values, rows, starts) in enumerate(self.tables):
            # all substrings may differ by `each`; with less left over than there are substrings, one of the others differs by less
            near = np.bitwise_count(values ^ code[j]) <= (each if j <= left else each - 1)
            if len(values) == len(rows):
                found[rows[near]] = True
            else:
                found[rows[np.repeat(near, np.diff(starts))]] = True
        return found

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows within `radius` bits of one code."""
        rows = np.flatnonzero(self.candidates(code, radius))
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


def _pack(codes: Codes):
    """A group of rows (code, first, v) as one row: its names, smallest vec_ids, binary codes and vectors."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["v"].to_numpy())
        return pd.DataFrame([(int(key[0]), rows["code"].tolist(), rows["first"].tolist(), codes.encode(x).tobytes(), x.tobytes())], columns=["part", "names", "firsts", "bits", "vectors"])

    return run


PACKED = "part int, names array<string>, firsts array<long>, bits binary, vectors binary"


def _search(codes: Codes, radius: int, k: int):
    def arrays(row, side: str) -> tuple[np.ndarray, np.ndarray]:
        n = len(row[f"{side}_names"])
        return np.frombuffer(row[f"{side}_bits"], np.uint64).reshape(n, -1), np.frombuffer(row[f"{side}_vectors"]).reshape(n, -1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                (xc, x), (qc, q) = arrays(row, "x"), arrays(row, "q")
                index, names, first = Index(xc), np.asarray(row["x_names"], object), np.asarray(row["x_firsts"])
                for i in range(len(q)):
                    rows = index.probe(qc[i], radius)
                    d = np.sqrt(((x[rows] - q[i]) ** 2).sum(axis=1))
                    best = np.lexsort((first[rows], d))[: k + 1]
                    yield pd.DataFrame({"q": row["q_names"][i], "c": names[rows[best]], "d": d[best]})

    return run


def _first(entries: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The rows with the smallest codes, `most` of them, and the number of all rows.

    Codes are hex digits of hashes. Only rows that begin no higher than the last one wanted are sorted, a few more than `most`.
    """
    starts = entries.groupBy(F.substring("code", 1, 3).alias("start")).count().orderBy("start").collect()  # 4,096 at most
    counts = np.cumsum([r["count"] for r in starts])
    at = min(int(np.searchsorted(counts, most)), len(starts) - 1)
    return entries.where(F.substring("code", 1, 3) <= starts[at]["start"]).orderBy("code").limit(most), int(counts[-1])


def neighbours(vectors: DataFrame, k: int = 10, every: int = 100, sample: int = SAMPLE, bits: int = BITS, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The k nearest other rows of each row whose vec_id is divisible by `every`: query_id, rank (from 1), vec_id, score.

    vectors: vec_id, embedding; other columns are ignored. score is the Euclidean distance in double precision, ties go
    to the smaller vec_id; all candidates where there are fewer than k. Vectors that are null, all zero, or hold a null
    or non-finite component take no part, nor do null vec_ids, nor vectors of another length than most. Repeated rows
    are one row; rows with one vec_id and other vectors are candidates each, but not for that vec_id's own queries. An
    empty table gives no rows.

    Equal vectors are one entry of the index that keeps its k + 1 smallest vec_ids, which is all that an answer can
    name, so a vector that a third of all rows share is searched once. A shard of the index is one row of packed codes
    and vectors and moves once; blocks of queries, a hundredth of the rows, are read beside every shard. What is kept of each
    meeting is k + 1 entries a query. Vectors are read only where the codes are near, but stay with their codes: the
    pairs within the radius outnumber the vectors.
    """
    none = F.array().cast("array<double>")
    v = F.transform(F.coalesce(F.col("embedding"), none), lambda x: x.cast("double"))
    fine = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine).select("vec_id", v.alias("v"))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not lengths:
        return empty
    rows = rows.where(F.size("v") == lengths[0]["n"]).select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.concat(*(F.hex(F.xxhash64(F.lit(salt), F.transform("v", lambda x: x + 0.0))) for salt in (0, 1))).alias("code"))
    ids = materialize(rows.select("code", "vec_id").distinct(), "mih_ids")
    entries = materialize(rows.groupBy("code").agg(F.min("vec_id").alias("first"), F.min("v").alias("v")), "mih_vectors")
    few, n = _first(entries, sample)  # codes are hashes, so this is a random draw
    few = materialize(few, "mih_sample").toPandas().sort_values("code")["v"]  # one task has chosen them: the driver gets `sample` rows, not some of each task
    codes = Codes.learn(np.stack(few.to_numpy()), bits, k)
    shards = ceil(n / shard)
    text_batches(vectors.sparkSession)
    index = entries.withColumn("part", F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int")).groupBy("part").applyInPandas(_pack(codes), PACKED)
    index = materialize(index.select(*(F.col(c).alias(f"x_{c}") for c in index.columns)), "mih_index")
    asked = materialize(ids.where(F.col("vec_id") % every == 0).select("code").distinct(), "mih_queries")
    blocks = ceil(asked.count() / block)
    if not blocks:
        return empty
    queries = materialize(asked.join(entries, "code").select("code", "first", "v", F.pmod(F.xxhash64("code", F.lit(1)), F.lit(blocks)).cast("int").alias("part")), "mih_asked")

    def search(some: DataFrame, radius: int) -> DataFrame:
        packed = some.groupBy("part").applyInPandas(_pack(codes), PACKED)
        packed = materialize(packed.select(*(F.col(c).alias(f"q_{c}") for c in packed.columns)), "mih_blocks")
        # tasks read shards and blocks from their tables: a join by shard would copy each block for each shard, and broadcast them all
        pairs = index.hint("shuffle_replicate_nl").crossJoin(packed)
        return pairs.mapInPandas(_search(codes, radius, k), "q string, c string, d double")

    # each entry found stands for its smallest vec_ids
    small = Window.partitionBy("code").orderBy("vec_id")
    members = ids.select("code", "vec_id", F.row_number().over(small).alias("n")).where(F.col("n") <= k + 1).groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    members = materialize(members, "mih_members")

    def answers(found: DataFrame) -> DataFrame:
        near = Window.partitionBy("q").orderBy("d", "least")
        best = found.join(members, found.c == members.code).select("q", "d", "members", F.col("members")[0].alias("least"))
        best = best.select("q", "d", "members", F.row_number().over(near).alias("n")).where(F.col("n") <= k + 1)
        best = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("d", "members"))).alias("near"))
        own = ids.where(F.col("vec_id") % every == 0).select("code", F.col("vec_id").alias("query_id"))
        pairs = own.join(best, own.code == best.q).select("query_id", F.explode(F.flatten(F.transform("near", lambda e: F.transform(e["members"], lambda m: F.struct(e["d"].alias("score"), m.alias("vec_id")))))).alias("p"))
        pairs = pairs.select("query_id", "p.score", "p.vec_id").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return pairs.select("query_id", F.row_number().over(rank).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

    first = materialize(answers(search(queries, codes.radius)), "mih_found")
    if codes.radius >= codes.bits:
        return first
    others = ids.select("vec_id").distinct().count() - 1
    short = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    asked_ids = ids.where(F.col("vec_id") % every == 0).select("vec_id", "code").distinct()
    short = asked_ids.join(short, asked_ids.vec_id == short.query_id, "left").where(F.coalesce("n", F.lit(0)) < min(k, others)).select("vec_id", "code")
    short = materialize(short, "mih_short")
    if not short.limit(1).count():
        return first
    again = answers(search(queries.join(short.select("code").distinct(), "code"), codes.bits)).join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_semi")
    done = first.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti")
    return done.union(again.select(*done.columns))
