"""Centroid clustering against plain rounds of k-means on Python integers."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from loomwork.llm import queries, shallot

NAN, INF = float("nan"), float("inf")


def plain(rows, k, rounds, size, salt=1):
    """(vec_id, cluster, distance) of each kept vector and the final centroids."""
    kept = [(i, [math.floor(64 * v) if abs(v) < 2**900 else int(v) * 64 for v in e]) for i, e in rows if e is not None and len(e) == size and all(v is not None and math.isfinite(v) for v in e)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [e for _, e in first[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    home = lambda e: min((dist(e, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        found = [(home(e)[1], e) for _, e in kept]
        for j in range(len(centroids)):
            mine = [e for h, e in found if h == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return [(i, home(e)[1], home(e)[0]) for i, e in kept], centroids


def check(spark, rows, k, rounds, size, kind="float"):
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], f"vec_id long, embedding array<{kind}>, cluster string, distance int").repartition(3)
    got = shallot.cluster(df, k, rounds, size).collect()
    if kind == "float":
        rows = [(i, e and [v if v is None else float(np.float32(v)) for v in e]) for i, e in rows]
    want, centroids = plain(rows, k, rounds, size)
    fits = lambda v: v if v < 2**63 else None
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=key) == sorted(((i, c, fits(d)) for i, c, d in want), key=key)
    for r in got:
        mine = sum(d for _, c, d in want if c == r["cluster"])
        assert r["cluster_inertia"] == fits(mine) and r["inertia"] == fits(sum(d for _, _, d in want))
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()
    return got


def test_query_against_plain_rounds(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op11_shallot(spark, sf).collect()
    want, _ = plain(rows, 16, 3, 64)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == sorted(want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    sql = con.execute(f"SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM ({queries.oracle_sql()['op11_shallot']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(sql)


@pytest.mark.parametrize("seed", range(3))
def test_small_grids_with_ties(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.integers(-3, 4, 4) / 64).tolist()) for i in range(150)]
    check(spark, rows + rows[:40], 7, 4, 4)


def test_odd_vectors(spark):
    ok = [(i, [i / 10, -i / 7]) for i in range(9)]
    odd = [(20, None), (21, [1.0]), (22, [1.0, None]), (23, [NAN, 1.0]), (24, [INF, 1.0]), (25, [1.0, -INF]), (26, []), (27, [1.0, 2.0, 3.0])]
    check(spark, ok + odd + [(None, [0.5, 0.5]), (3, [0.3, 0.2]), (2**53 + 1, [9.0, 9.0])], 4, 3, 2)
    check(spark, odd, 4, 3, 2)
    check(spark, ok[:2], 4, 3, 2)
    check(spark, [(1, [1.0, 1.0])] * 5, 3, 2, 2)
    check(spark, ok, 1, 2, 2)


def test_large_components(spark):
    rows = [(i, [(-1.0) ** i * 10.0**i, 0.25]) for i in range(0, 38, 3)]
    check(spark, rows, 4, 3, 2)
    check(spark, [(i, [2.0**k, -1.5]) for i, k in enumerate((3, 25, 26, 40, 62, 100, 500))], 3, 3, 2, "double")


def test_bounds_save_distances(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 4, (12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.3, 8)).tolist()) for i in range(1200)]
    got = check(spark, rows, 12, 4, 8)
    # the first scan takes 12 distances of each vector, and a plain round would again
    assert sum(r["looked"] for r in got) / len(got) < 12 + 4 * 4


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert shallot.cluster(df).count() == 0
