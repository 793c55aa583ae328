"""Streams on hand-made batches: lateness, silence, running totals, options of topics; and sinks that must not lose a table."""

import datetime

import pytest
from pyspark.sql import functions as F

from loomwork.operators import sinks as S
from loomwork.session import work_path
from loomwork.sources.stream import stream_table, topic_options
from loomwork.streaming import operators as T
from loomwork.streaming import stateful as W

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def run(spark, batches, schema, build, keys):
    """The last state of each key after the batches, one after the other from one checkpoint, and the batches themselves."""
    source, path, check = (work_path(spark, n) for n in ("source", "stream", "check"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        out = build(stream_table(spark, source, spark.createDataFrame([], schema).schema, None))
        T.keep_batches(out, path, check, "update")
    return T.latest(spark, path, keys, out.schema).collect()


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def test_rows_behind_the_watermark_are_dropped(spark):
    batches = [[(at(0), "a"), (at(125), "a")], [(at(126), "a")], [(at(1), "a"), (at(127), "a"), (at(119), "a")]]
    got = run(spark, batches, "at timestamp, k string", lambda s: W.pane_count(s, ["k"], "10 minutes", "10 minutes", "10 minutes"), ["pane", "k"])
    # minute 1 is behind the newest by more than ten, so its window is closed; minute 119 is late but its window is open
    assert {f"{r['pane']:%H:%M}": r["n"] for r in got} == {"00:00": 1, "02:00": 3, "01:50": 1}


def test_count_restarts_from_zero_after_silence(spark):
    batches = [[(at(0), "a"), (at(10), "a"), (at(0), "b")], [(at(30), "b")], [(at(200), "b"), (at(200), "c")], [(at(210), "a"), (at(211), "a"), (at(215), "b")]]
    got = run(spark, batches, "at timestamp, k string", lambda s: T.running_count_ttl(s, "k", "60 minutes", "5 minutes"), ["key"])
    assert {r["key"]: r["n"] for r in got} == {"a": 2, "b": 2, "c": 1}


def test_running_totals_over_two_batches(spark):
    batches = [[("bj", 100), ("sh", 300), ("hz", 240)], [("bj", 1000), ("sh", 40), ("nj", 80)]]
    got = run(spark, batches, "k string, v int", lambda s: T.running_total(s, ["k"], "v"), ["k"])
    assert {r["k"]: r["total"] for r in got} == {"bj": 1100, "sh": 340, "hz": 240, "nj": 80}


@pytest.mark.parametrize("rows", [[], [(None,)], [(5,)], [(i,) for i in range(7)]])
def test_slices_hold_every_row_once(spark, rows):
    df = spark.createDataFrame(rows, "x long")
    got = [r["s"] for r in df.orderBy("x").select(T.slice_of(df, "x", 3).alias("s")).collect()]
    assert got == sorted(got) and all(0 <= s < 3 for s in got) and (len(rows) < 7 or got == [0, 0, 0, 1, 1, 2, 2])


def test_topic_options():
    assert topic_options("h:1,h:2", ["a", "b"], "earliest", 96_000) == {"kafka.bootstrap.servers": "h:1,h:2", "subscribe": "a,b", "startingOffsets": "earliest", "maxOffsetsPerTrigger": "96000"}
    assert topic_options("h:1", ["a"], {"a": {0: 23, 1: -2}})["startingOffsets"] == '{"a": {"0": 23, "1": -2}}'
    assert "maxOffsetsPerTrigger" not in topic_options("h:1", ["a"])


def test_files_of_a_batch_are_bounded(spark):
    source = work_path(spark, "files")
    for k in range(5):
        spark.range(1).select(F.lit(k).alias("k")).coalesce(1).write.mode("append").parquet(source)
    path = work_path(spark, "stream")
    T.keep_batches(stream_table(spark, source, spark.read.parquet(source).schema, 2), path, work_path(spark, "check"))
    assert sorted(r["count"] for r in spark.read.parquet(path).groupBy("batch_id").count().collect()) == [1, 2, 2]


def test_replacing_a_table_leaves_no_other_version(spark):
    path = work_path(spark, "snapshot")
    for n in (3, 5):
        S.replace_snapshot(spark.range(n), path)
        assert spark.read.parquet(path).count() == n and not S.exists(spark, f"{path}.old") and not S.exists(spark, f"{path}.new")


def test_merge_updates_inserts_and_keeps(spark):
    url = "jdbc:derby:memory:merge_test;create=true"
    login = {"user": "app", "password": "app"}
    S.write_jdbc(spark.createDataFrame([(1, 10), (2, 20)], "k int, v int"), url, "T", login, "overwrite")
    for _ in range(2):
        S.merge_jdbc(spark.createDataFrame([(2, 21), (2, 22), (3, 30)], "k int, v int"), url, "T", ["k"], login)
    assert sorted(map(tuple, spark.read.jdbc(url, "T", properties=login).collect())) == [(1, 10), (2, 22), (3, 30)]
