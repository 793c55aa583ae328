"""Streaming operators with state of their own: panes and closed windows, ranks inside the stream, counts by empty batches, the blacklist."""

import datetime
import random
import subprocess
import sys
from collections import Counter, defaultdict

from pyspark.sql import Row
from pyspark.sql import functions as F

from loomwork.session import work_path
from loomwork.sources.stream import stream_table
from loomwork.streaming import operators as T
from loomwork.streaming import stateful as W

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
MIN = 60


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def run(spark, batches, schema, build, mode="append"):
    """All rows that build(stream) gives, with their batch, when the batches arrive one after the other."""
    source, path, check = (work_path(spark, n) for n in ("source", "stream", "check"))
    for rows in batches:
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(source)
        out = build(stream_table(spark, source, spark.createDataFrame([], schema).schema, None))
        with W.state_on_disk(spark):
            T.keep_batches(out, path, check, mode)
    return spark.read.parquet(path).collect()


def windows(rows, size, slide):
    out = Counter()
    for m, k in rows:
        for s in range(m // slide * slide - size + slide, m // slide * slide + 1, slide):
            out[s, k] += 1
    return out


def test_fold_keeps_sums_and_nulls(spark):
    rows = [("a", 1), ("a", 2), (None, 5), ("b", 7), (None, 1)]
    got = W.fold(spark.createDataFrame(rows * 50, "k string, n int").repartition(2), ["k"])
    assert {r["k"]: r["s"] for r in got.groupBy("k").agg(F.sum("n").alias("s")).collect()} == {"a": 150, None: 300, "b": 350}
    assert got.count() <= 6


def test_panes_sum_to_windows(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(200), rng.choice("abc")) for _ in range(300)]
    panes = spark.createDataFrame([(at(m), k) for m, k in rows], "at timestamp, k string").groupBy(F.window("at", W.pane("15 minutes", "10 minutes")).alias("p"), "k").agg(F.count(F.lit(1)).alias("n"))
    got = W.windows_of_panes(panes.select(F.col("p.start").alias("pane"), "k", "n"), ["k"], "15 minutes", "10 minutes").collect()
    want = Counter()
    for m, k in rows:
        for s in range(-20, 200, 10):
            want[s, k] += s <= m < s + 15
    assert {(r["start_time"], r["k"]): r["n"] for r in got} == {(f"{at(s):%Y-%m-%d %H:%M:%S}", k): n for (s, k), n in want.items() if n}
    assert W.pane("10 minutes", "4 minutes") == f"{2 * 60_000} milliseconds"


def test_closed_windows_are_ranked_once(spark):
    rng = random.Random(7)
    rows = sorted((rng.randrange(300), rng.randrange(12)) for _ in range(600))
    batches = [[(at(m), k) for m, k in rows if lo <= m < lo + 100] for lo in (0, 100, 200)] + [[(at(2000), None)]]
    got = run(spark, batches, "at timestamp, k int", lambda s: W.window_best(W.closed_windows(s, ["k"], "20 minutes", "10 minutes", "5 minutes"), 3, "k"))
    counts, want = defaultdict(list), {}
    for (s, k), n in windows(rows, 20, 10).items():
        counts[s].append((-n, k))
    for s, found in counts.items():
        for r, (n, k) in enumerate(sorted(found)[:3], 1):
            want[f"{at(s):%Y-%m-%d %H:%M:%S}", r] = (str(k), -n)
    assert len(got) == len(want) and {(r["start_time"], r["rank"]): (r["k"], r["n"]) for r in got} == want
    assert len({r["batch_id"] for r in got}) > 2  # windows come as they close


def test_count_by_empty_batches(spark):
    # limit 1: the counter is 0, 1, 2 on the first empty hours, and on the third the count goes
    batches = [[(at(0), "a"), (at(30), "a"), (at(0), "b"), (at(5), "c")], [(at(3 * 60 - 1), "a"), (at(4 * 60 + 1), "b")], [(at(6 * 60), "a"), (at(7 * 60 + 59), "b"), (at(1), "late")], [(at(30 * 60), "c"), (at(30 * 60), "c")]]
    got = run(spark, batches, "at timestamp, k string", lambda s: W.count_until_idle(s, ["k"], "1 hour", 1, "1 hour"))
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["batch_id"]):
        by[r["k"]].append(r["n"])
    # a: hour 2 after hours 0 (one empty), hour 6 after 2 (three empty: from zero); b: hour 4 after 0 (three), hour 7 after 4 (two)
    assert by == {"a": [2, 3, 1], "b": [1, 1, 2], "c": [1, 2]}


def test_hot_key_is_folded_before_state(spark):
    rows = [(at(m % 60), "hot") for m in range(3000)]
    got = run(spark, [rows], "at timestamp, k string", lambda s: W.count_until_idle(s, ["k"], "1 hour", 1, "1 hour"))
    assert [(r["k"], r["n"]) for r in got] == [("hot", 3000)]


def test_blacklist_against_brute_force(spark):
    rng = random.Random(11)
    rows = sorted((rng.randrange(4000), rng.randrange(25)) for _ in range(900))
    batches = [[r for r in rows if lo <= r[0] < lo + 800] for lo in range(0, 4000, 800)]
    white = spark.createDataFrame([(3,), (3,)], "user_id int")
    stream = [[(at(m), u, m % 7) for m, u in b] for b in batches]
    got = run(spark, stream, "at timestamp, user_id int, ad int", lambda s: W.blacklisted(s, "user_id", ["ad"], "240 minutes", "60 minutes", 5, white, "60 minutes"))
    mine = Counter()
    for r in got:
        mine[r["batch_id"], r["user_id"], r["ad"], r["listed"]] += r["n"]
    want, seen, black = Counter(), [], set()
    for i, b in enumerate(batches):
        seen += b
        black |= {u for (_, u), n in windows(seen, 240, 60).items() if n > 5 and u != 3}
        for m, u in b:
            want[i, u, m % 7, u in black] += 1
    order = {b: i for i, b in enumerate(sorted({k[0] for k in mine}))}
    assert Counter({(order[b], *k): n for (b, *k), n in mine.items()}) == want
    assert 3 < len(black) < 24


def test_blacklist_reads_no_history(spark):
    """Rows that a batch reads are its own, however many came before."""
    source, check, read = work_path(spark, "source"), work_path(spark, "check"), []
    white = spark.createDataFrame([], "user_id int")
    for day in range(4):
        spark.createDataFrame([(at(1440 * day + m), m % 9) for m in range(200)], "at timestamp, user_id int").coalesce(1).write.mode("append").parquet(source)
        out = W.blacklisted(stream_table(spark, source, "at timestamp, user_id int", None), "user_id", [], "240 minutes", "60 minutes", 10**6, white, "60 minutes")
        with W.state_on_disk(spark):
            query = out.writeStream.format("noop").option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()
        read.append([(p["numInputRows"], p["stateOperators"][0]["numRowsTotal"]) for p in query.recentProgress if p["numInputRows"]])
    assert [x[0][0] for x in read] == [200] * 4
    assert max(x[0][1] for x in read) <= 2 * min(x[0][1] for x in read)  # the ring is bounded


class Store:
    """A state store of one key that counts its calls."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return 0


def test_blacklist_calls_the_store_a_few_times_a_user():
    """However many panes a user has, and with one timer at a time, which is over when no pane is in reach."""
    store, row = Store(), Row("user_id", "ms", "n", "white")
    user = W._Listed(3_600_000, 4, 1, 5, ["user_id", "ms", "n"])
    user.init(store)
    for batch in range(3):
        rows = [row(1, (batch * 40 + p) * 3_600_000, 1, False) for p in range(40)]
        assert [r["listed"] for r in user.handleInputRows((1,), iter(rows), store)] == [False] * 40
    assert store.calls <= 12 and store.timers == {(119 + 1 + 4) * 3_600_000}
    assert all(r["listed"] for r in user.handleInputRows((1,), iter([row(1, 3_600_000 * 119, 9, False)]), store))
    assert store.value[:3] == (True, [], []) and not store.timers
    assert all(r["listed"] for r in user.handleInputRows((1,), iter([row(1, 3_600_000 * 500, 1, False)]), store))
    user.handleExpiredTimer((1,), store, None)
    assert store.value is None


CONSOLE = """
from pyspark.sql import SparkSession
from loomwork.session import work_path
from loomwork.sources.stream import stream_table
from loomwork.streaming import operators as T
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
source = work_path(spark, "source")
spark.createDataFrame([("seen",), ("seen",)], "k string").write.parquet(source)
T.to_console(T.running_count(stream_table(spark, source, "k string", None), ["k"]), work_path(spark, "check"))
"""


def test_console():
    done = subprocess.run([sys.executable, "-c", CONSOLE], capture_output=True, text=True, timeout=300)
    assert "Batch: 0" in done.stdout and "|seen|2  |" in done.stdout, done.stderr[-2000:]
