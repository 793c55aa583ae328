"""Long lists by a filter, joins of bucketed tables, buffers of the largest values, counters of batches."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomwork.operators import aggregates as A
from loomwork.operators import relational as R
from loomwork.operators import sinks as S
from loomwork.plans import batch


@pytest.mark.parametrize("most", [64, 1 << 20])
def test_filter_rules_out_and_the_join_decides(spark, most):
    df = spark.range(3000).withColumn("id", F.when(F.col("id") % 97 == 0, None).otherwise(F.col("id"))).withColumn("x", F.lit(1))
    listed = spark.range(0, 3000, 3).union(spark.range(0, 30, 3))
    rows, seen = R.exclude_filtered(df, listed, "id", most)
    got = sorted(str(r["id"]) for r in rows.collect())
    assert got == sorted(str(i if i % 97 else None) for i in range(3000) if i % 97 == 0 or i % 3)
    in_vain = seen.get["rows"]
    assert in_vain > 1500 if most == 64 else in_vain < 120  # a full filter lets all through, and the result is the same
    assert len(R.bloom_filter(listed, "id", most)) * 64 <= most
    nothing, _ = R.exclude_filtered(df, listed.limit(0), "id")
    assert nothing.count() == 3000


def test_only_what_may_be_listed_is_shuffled(spark):
    df, listed = spark.range(2000).withColumn("x", F.lit(1)), spark.range(0, 40)
    rows, _ = R.exclude_filtered(df, listed, "id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftAnti") == 1 and "Union" in plan


def test_bucketed_join_moves_nothing(spark):
    S.save_bucketed(spark.range(500).select(F.col("id").alias("a"), F.lit(1).alias("x")), "bucketed_a", "a", 4)
    S.save_bucketed(spark.range(0, 500, 2).select(F.col("id").alias("b"), F.lit(2).alias("y")), "bucketed_b", "b", 4)
    a, b = spark.table("bucketed_a"), spark.table("bucketed_b")
    out = a.join(b.hint("merge"), a.a == b.b)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert out.count() == 250
    grouped = batch.QUERIES["d2_join_bucketed"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert grouped.count("Exchange") == 1 and grouped.index("Exchange") < grouped.index("SortMergeJoin")  # of the sums by name, above the join


@pytest.mark.parametrize("held", [1, 50, 100_000])
def test_buffers_of_the_largest(spark, monkeypatch, held):
    monkeypatch.setattr(A, "HELD", held)
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.choice([None, 2**53 + 1, *range(30)])) for _ in range(900)] + [("empty", None)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(5)
    best = defaultdict(list)
    for k, v in rows:
        if v is not None:
            best[k].append(v)
    want = {k: ",".join(map(str, sorted(v, reverse=True)[:4])) for k, v in best.items()}
    assert {r["k"]: r["top"] for r in A.merged_topn(df, "k", "v", 4).collect()} == want
    assert A.top_partials(df, "k", "v", 4).count() <= 5 * 4 * len(want)
    assert A.merged_topn(df.limit(0), "k", "v", 4).count() == 0
