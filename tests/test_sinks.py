"""Keyed sinks: buckets that are not touched stay, crashes in between lose nothing, a batch is taken over by a database once."""

import pytest

from loomwork.operators import sinks as S
from loomwork.plans.batch import database
from loomwork.session import work_path
from loomwork.sources.batch import read_jdbc
from loomwork.sources.stream import stream_table
from loomwork.streaming import operators as T


def files(spark, path):
    return set(spark.read.parquet(path).inputFiles())


def rows(spark, path):
    return sorted(map(tuple, S.keyed_table(spark, path).collect()), key=str)


def test_upsert_leaves_other_buckets_alone(spark):
    path = work_path(spark, "keyed")
    S.upsert(spark.createDataFrame([(k, k) for k in range(200)] + [(None, 0)], "k int, v int"), path, ["k"], buckets=8)
    before = files(spark, path)
    S.upsert(spark.createDataFrame([(7, 70), (7, 71)], "k int, v int"), path, ["k"], buckets=99)
    after = files(spark, path)
    assert len(before - after) == 1 and len(before & after) == len(before) - 1
    S.upsert(spark.createDataFrame([(None, 5), (300, 1)], "k int, v int"), path, ["k"])
    assert rows(spark, path) == sorted([(k, 71 if k == 7 else k) for k in range(200)] + [(None, 5), (300, 1)], key=str)


def test_upsert_of_no_rows_and_keys_only(spark):
    path = work_path(spark, "keyed")
    S.upsert(spark.createDataFrame([], "k int"), path, ["k"])
    assert rows(spark, path) == []
    for _ in range(2):
        S.upsert(spark.createDataFrame([(1,), (1,), (2,)], "k int"), path, ["k"])
    assert rows(spark, path) == [(1,), (2,)]


def test_upsert_goes_on_after_a_crash(spark):
    path = work_path(spark, "keyed")
    S.upsert(spark.createDataFrame([(k, k) for k in range(50)], "k int, v int"), path, ["k"], buckets=4)
    real, calls = S._finish, []

    def crash(session, at):
        calls.append(at)
        if len(calls) == 2:  # new buckets are aside as a whole, and one old one is gone already
            here, fs = S._hadoop(session, path)
            fs.delete(S._hadoop(session, f"{path}/_bucket=1")[0], True)
            raise RuntimeError("crash")
        real(session, at)

    S._finish = crash
    try:
        with pytest.raises(RuntimeError):
            S.upsert(spark.createDataFrame([(k, k + 1) for k in range(50)], "k int, v int"), path, ["k"])
    finally:
        S._finish = real
    S.upsert(spark.createDataFrame([(99, 99)], "k int, v int"), path, ["k"])
    assert dict(rows(spark, path)) == {k: k + 1 for k in range(50)} | {99: 99}


def test_a_write_aside_that_did_not_end_is_dropped(spark):
    path = work_path(spark, "keyed")
    S.upsert(spark.createDataFrame([(1, 1)], "k int, v int"), path, ["k"])
    spark.createDataFrame([(5, 5, 3)], "k int, v int, _bucket int").write.partitionBy("_bucket").parquet(f"{path}.next")
    fs = S._hadoop(spark, path)[1]
    fs.delete(S._hadoop(spark, f"{path}.next/_SUCCESS")[0], False)
    S.upsert(spark.createDataFrame([(2, 2)], "k int, v int"), path, ["k"])
    assert rows(spark, path) == [(1, 1), (2, 2)]


def test_snapshot_comes_back_after_a_crash(spark):
    path = work_path(spark, "snapshot")
    S.replace_snapshot(spark.range(3), path)
    here, fs = S._hadoop(spark, path)
    fs.rename(here, S._hadoop(spark, f"{path}.old")[0])  # crash between putting aside and putting in place
    S.recover(spark, path)
    assert spark.read.parquet(path).count() == 3


TYPES = "k VARCHAR(20), n BIGINT, last BIGINT"


def test_batch_is_taken_over_once(spark):
    url = database(spark, "once_test")
    put = lambda batch, data, job="j": S.commit_jdbc(spark.createDataFrame(data, "k string, n long, last long"), url, "T", ["k"], job, batch, {}, ["n"], TYPES)
    assert put(0, [("a", 1, 5), ("a", 2, 4), ("b", 1, 1)])
    assert not put(0, [("a", 1, 5), ("a", 2, 4), ("b", 1, 1)])
    assert put(1, [("a", 10, 9), ("c", 1, 1)]) and put(1, [("b", 4, 0)], "other")
    assert sorted(map(tuple, read_jdbc(spark, url, "T", {}).collect())) == [("a", 13, 9), ("b", 5, 0), ("c", 1, 1)]


def test_failed_transaction_leaves_no_note(spark):
    url = database(spark, "fails")
    S.commit_jdbc(spark.createDataFrame([("a", 1)], "k string, n long"), url, "T", ["k"], "j", 0, {}, ["n"], "k VARCHAR(3), n BIGINT")
    with pytest.raises(Exception):  # the key does not fit into the target, so the merge fails after the note
        S.commit_jdbc(spark.createDataFrame([("long key", 1), ("a", 7)], "k string, n long"), url, "T", ["k"], "j", 1, {}, ["n"], "k VARCHAR(20), n BIGINT")
    assert S.commit_jdbc(spark.createDataFrame([("a", 5)], "k string, n long"), url, "T", ["k"], "j", 1, {}, ["n"], "k VARCHAR(3), n BIGINT")
    assert [tuple(r) for r in read_jdbc(spark, url, "T", {}).collect()] == [("a", 6)]


def test_crash_between_write_and_checkpoint_adds_nothing_twice(spark):
    url, source, check = database(spark, "crash"), work_path(spark, "source"), work_path(spark, "check")
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long").coalesce(1).write.parquet(source)
    crashed = []

    def step(batch, i):
        S.commit_jdbc(batch, url, "T", ["k"], "j", i, {}, ["n"], "k VARCHAR(20), n BIGINT")
        if not crashed:
            crashed.append(i)
            raise RuntimeError("the batch is written, the checkpoint is not")

    stream = lambda: stream_table(spark, source, "k STRING, n BIGINT", None)
    with pytest.raises(Exception):
        T.run_batches(stream(), step, check)
    spark.createDataFrame([("a", 10)], "k string, n long").coalesce(1).write.mode("append").parquet(source)
    T.run_batches(stream(), step, check)
    assert sorted(map(tuple, read_jdbc(spark, url, "T", {}).collect())) == [("a", 11), ("b", 2)]
