"""Queries of the streaming operators: a table is cut into files, streamed a file a batch, and the final table returned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators import aggregates as A
from loomwork.operators import relational as R
from loomwork.operators import sinks as S
from loomwork.plans.batch import BLACK, CLICKS, KIND, OC, W1, blacklist, click_lines, database, order_lines, orders_customers
from loomwork.session import table, work_path
from loomwork.sources import records as P
from loomwork.sources.batch import read_jdbc
from loomwork.sources.stream import stream_lines, stream_table
from loomwork.streaming import operators as T
from loomwork.streaming import stateful as W

QUERIES: dict = {}
ORACLES: dict = {}
SLICES = 3


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def streamed(spark, df: DataFrame, by: str) -> DataFrame:
    files = max(SLICES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return stream_table(spark, T.slices(df, by, files), df.schema, -(-files // SLICES))


def final(spark, sdf: DataFrame, keys, mode="update") -> DataFrame:
    path = work_path(spark, "stream")
    T.keep_batches(sdf, path, work_path(spark, "checkpoint"), mode)
    return T.latest(spark, path, keys, sdf.schema)


def ordered(spark, df: DataFrame, by: str, build, keys) -> DataFrame:
    """The last state of each key of build(stream) over df, whose slices arrive in the order of `by`."""
    path, check, schema = work_path(spark, "stream"), work_path(spark, "checkpoint"), []

    def run(sdf: DataFrame) -> None:
        out = build(sdf)
        schema.append(out.schema)
        T.keep_batches(out, path, check, "update")

    T.in_order(df, by, SLICES, run)
    return T.latest(spark, path, keys, schema[0])


def sliced_sql(value: str) -> str:
    """events with the slice that in_order() puts each row in."""
    return f"(SELECT *, event_id % 20 AS ad_id, CAST(({value} - min({value}) OVER ()) * {SLICES} // (max({value}) OVER () - min({value}) OVER () + 1) AS INT) AS slice FROM events)"


def clicks(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"), "user_id", "event_type", (F.col("event_id") % 20).alias("ad_id"))


@query("a13_stream_lines", "SELECT event_type AS value, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def a13(spark, sf):
    path = work_path(spark, "text")
    S.write_text(table(spark, sf, "events").select("event_type"), path)
    return final(spark, T.running_count(stream_lines(spark, "text", path=path), ["value"]), ["value"])


@query("a14_union_streams", "SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT user_id FROM events WHERE event_type = 'click' UNION ALL SELECT user_id FROM events WHERE event_type = 'view') GROUP BY 1")
def a14(spark, sf):
    rows = clicks(spark, sf)
    both = streamed(spark, rows.where("event_type = 'click'"), "event_id").unionByName(streamed(spark, rows.where("event_type = 'view'"), "event_id"))
    return final(spark, T.running_count(both, ["user_id"]), ["user_id"])


@query("s1_per_batch", f"SELECT event_type, CAST(count(*) AS BIGINT) AS n, slice AS batch_id FROM {sliced_sql('event_id')} GROUP BY ALL")
def s1(spark, sf):
    path, check = work_path(spark, "per_batch"), work_path(spark, "checkpoint")
    write = lambda b, i: A.group_count(b, ["event_type"]).write.mode("overwrite").parquet(f"{path}/batch_id={i}")
    T.in_order(clicks(spark, sf), "event_id", SLICES, lambda sdf: T.run_batches(sdf, write, check))
    return spark.read.schema("event_type STRING, n BIGINT, batch_id INT").parquet(path)


TOTALS = f"SELECT province_id, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN o_orderkey % 83 <> 0 THEN c_nationkey END AS province_id, floor(o_totalprice) AS price FROM {OC} WHERE o_orderkey % 71 <> 0) GROUP BY 1"


def order_totals(spark, sf):
    lines = order_lines(spark, sf)
    return T.running_total(P.parse_order_csv(streamed(spark, lines, "value")), ["province_id"], "price")


@query("s2_running_total_all", TOTALS)
def s2(spark, sf):
    sdf, path = order_totals(spark, sf), work_path(spark, "snapshot")
    T.run_batches(sdf, lambda b, i: S.replace_snapshot(b, path), work_path(spark, "checkpoint"), "complete")
    return spark.read.schema(sdf.schema).parquet(path)


@query("s3_running_total_changed", TOTALS)
def s3(spark, sf):
    return final(spark, order_totals(spark, sf), ["province_id"])


@query("s4_running_count", f"SELECT province, city, ad_id, CAST(count(*) AS BIGINT) AS n FROM {CLICKS} GROUP BY 1, 2, 3")
def s4(spark, sf):
    keys = ["province", "city", "ad_id"]
    return final(spark, T.running_count(P.parse_ad_click(streamed(spark, click_lines(spark, sf), "value")), keys), keys)


IDLE = """SELECT CAST(user_id AS VARCHAR) AS key, CAST(count(*) AS BIGINT) AS n, max(ms) AS last_ms FROM (
SELECT user_id, ms, run, max(run) OVER (PARTITION BY user_id) AS last FROM (
SELECT *, sum(CASE WHEN ms - before > 21600000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events))) WHERE run = last GROUP BY user_id"""


@query("s5_running_count_ttl", IDLE)
def s5(spark, sf):
    return ordered(spark, clicks(spark, sf), "at", lambda sdf: T.running_count_ttl(sdf, "user_id", "6 hours", "1 hour"), ["key"])


#: Counts by province and hour batches: a run ends when 12 or more hours are empty, as the counter has passed 10 on an empty hour.
EMPTY = """SELECT province, CAST(count(*) AS BIGINT) AS n, max(hour) AS last_interval FROM (
SELECT province, hour, run, max(run) OVER (PARTITION BY province) AS last FROM (
SELECT *, sum(CASE WHEN hour - before > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY province ORDER BY hour, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
SELECT user_id % 34 AS province, event_id, epoch_ms(ts) // 3600000 AS hour, lag(epoch_ms(ts) // 3600000) OVER (PARTITION BY user_id % 34 ORDER BY epoch_ms(ts) // 3600000, event_id) AS before FROM events))) WHERE run = last GROUP BY province"""


@query("s5_count_by_empty_batches", EMPTY)
def s5_empty(spark, sf):
    """The running count of a province is forgotten by the number of hours in a row without it."""
    rows = clicks(spark, sf).withColumn("province", F.col("user_id") % 34)
    path, check, schema = work_path(spark, "stream"), work_path(spark, "checkpoint"), []

    def run(sdf: DataFrame) -> None:
        out = W.count_until_idle(sdf, ["province"], "1 hour", 10, "1 hour")
        schema.append(out.schema)
        with W.state_on_disk(spark):
            T.keep_batches(out, path, check)

    T.in_order(rows, "at", SLICES, run)
    return T.latest(spark, path, ["province"], schema[0])


def windows_sql(key: str, size: int, slide: int, source: str) -> str:
    """Counts of (start, key) by a join of each row with the starts of the windows that hold it."""
    return f"SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start_time, strftime(s + INTERVAL {size} MINUTE, '%Y-%m-%d %H:%M:%S') AS end_time, {key}, CAST(count(*) AS BIGINT) AS n FROM (SELECT time_bucket(INTERVAL {slide} MINUTE, ts, TIMESTAMP '1970-01-01') - to_minutes({slide} * i) AS s, * FROM {source}, range(0, {size // slide}) r(i)) GROUP BY 1, 2, 3"


EVENTS = "(SELECT *, event_id % 20 AS ad_id FROM events)"


def paned(spark, df: DataFrame, keys: list[str], size: str, slide: str) -> DataFrame:
    """Windows of df as a stream in the order of `at`: its rows are counted by pane, and windows are sums of panes."""
    panes = ordered(spark, df, "at", lambda sdf: W.pane_count(sdf, keys, size, slide, "1 hour"), ["pane", *keys])
    return W.windows_of_panes(panes, keys, size, slide)


@query("s13_window_count", windows_sql("ad_id", 10, 1, EVENTS))
def s13(spark, sf):
    return paned(spark, clicks(spark, sf), ["ad_id"], "10 minutes", "1 minute")


@query("s14_window_word_count", windows_sql("event_type", 30, 10, EVENTS))
def s14(spark, sf):
    return paned(spark, clicks(spark, sf), ["event_type"], "30 minutes", "10 minutes")


@query("s15_window_reduce", windows_sql("user_id", 60, 30, EVENTS))
def s15(spark, sf):
    return paned(spark, clicks(spark, sf), ["user_id"], "60 minutes", "30 minutes")


DAYS = f"(SELECT o_orderdate AS ts, c_nationkey AS province FROM {OC})"


def province_rows(spark, sf):
    return orders_customers(spark, sf).select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"), F.col("c_nationkey").alias("province"))


@query("s16_window_group_count", windows_sql("province", 28800, 14400, DAYS))
def s16(spark, sf):
    return paned(spark, province_rows(spark, sf), ["province"], "20 days", "10 days")


TOP_WINDOWS = f"SELECT start_time, end_time, province, n, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY start_time ORDER BY n DESC, province) AS r FROM ({windows_sql('province', 28800, 14400, DAYS)})) WHERE r <= 5"


def best_provinces(spark, df: DataFrame, build) -> DataFrame:
    """The five provinces with most rows of each window, ranked inside the stream: panes, windows and ranks follow each other as windows close."""
    path, check = work_path(spark, "stream"), work_path(spark, "checkpoint")

    def run(sdf: DataFrame) -> None:
        best = W.window_best(W.closed_windows(build(sdf), ["province"], "20 days", "10 days", "1 day"), 5, "province")
        with W.state_on_disk(spark):
            T.keep_batches(best, path, check)

    T.in_order(df, "at", SLICES, run, T.closing_row(df, "at", "60 days"))
    rows = spark.read.schema("start_time STRING, end_time STRING, province STRING, n BIGINT, rank INT").parquet(path)
    return rows.withColumn("province", F.col("province").cast("long")).drop("batch_id")


@query("s17_window_topn", TOP_WINDOWS)
def s17(spark, sf):
    return best_provinces(spark, province_rows(spark, sf), lambda sdf: sdf)


LIMIT, SIZE, SLIDE = 5, "1440 minutes", "360 minutes"
HEAVY = f"SELECT DISTINCT user_id FROM ({windows_sql('user_id', 1440, 360, EVENTS)}) WHERE n > {LIMIT} AND user_id % 10 <> 1"


def marked_clicks(spark, sf, keep=(), white=None) -> DataFrame:
    """Clicks (with their hour) in the order of their time, folded to user, pane and the columns of `keep`, with the mark of users that windows have listed so far."""
    if white is None:
        white = clicks(spark, sf).where("user_id % 10 = 1").select("user_id").distinct()
    path, check, schema = work_path(spark, "marked"), work_path(spark, "checkpoint"), []

    def run(sdf: DataFrame) -> None:
        out = W.blacklisted(sdf, "user_id", keep, SIZE, SLIDE, LIMIT, white, "1 day")
        schema.append(out.schema)
        with W.state_on_disk(spark):
            T.keep_batches(out, path, check)

    T.in_order(clicks(spark, sf).withColumn("hour", F.date_format("at", "yyyyMMddHH")), "at", SLICES, run)
    return spark.read.schema(schema[0]).parquet(path)


@query("s18_update_blacklist", HEAVY)
def s18(spark, sf):
    return marked_clicks(spark, sf).where("listed").select("user_id").distinct()


SLICED = sliced_sql("(epoch_us(ts) // 1000)")


def unlisted_sql(white: str, good: str = "true") -> str:
    """events by slice without the users that windows over the slices so far have listed; of those only that are good."""
    heavy = lambda i: f"(SELECT user_id FROM ({windows_sql('user_id', 1440, 360, f'(SELECT * FROM {SLICED} WHERE slice <= {i} AND {good})')}) WHERE n > {LIMIT} AND NOT ({white}))"
    return "(" + " UNION ALL ".join(f"SELECT * FROM {SLICED} WHERE slice = {i} AND {good} AND user_id NOT IN {heavy(i)}" for i in range(SLICES)) + ")"


@query("s19_filter_blacklist", f"SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM {unlisted_sql('user_id % 10 = 1')} GROUP BY 1")
def s19(spark, sf):
    return marked_clicks(spark, sf).where("NOT listed").groupBy("user_id").agg(F.sum("n").alias("n"))


@query("e16_stream_counters", f"SELECT slice AS batch_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE trim(event_type) = '') AS BIGINT) AS n_blank FROM {sliced_sql('event_id')} GROUP BY 1")
def e16_stream(spark, sf):
    """Counters of each batch, gathered by a listener beside the stream."""
    check, found = work_path(spark, "checkpoint"), []
    work = lambda sdf: T.run_batches(sdf, lambda b, i: b.write.format("noop").mode("overwrite").save(), check)
    T.in_order(clicks(spark, sf), "event_id", SLICES, lambda sdf: found.extend(T.count_batches(sdf, "event_type", work)))
    return spark.createDataFrame([(i, x["rows"], x["blank"]) for i, x in found], "batch_id INT, n_rows BIGINT, n_blank BIGINT")


@query("s20_restart", "SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def s20(spark, sf):
    """The stream is stopped after the first files, more arrive, and it goes on from its checkpoint."""
    rows, source, check, path = clicks(spark, sf), work_path(spark, "source"), work_path(spark, "checkpoint"), work_path(spark, "stream")
    half = rows.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    for part in (rows.where(F.col("event_id") <= half), rows.where(F.col("event_id") > half)):
        part.write.mode("append").parquet(source)
        sdf = T.running_count(stream_table(spark, source, rows.schema, None), ["user_id"])
        T.keep_batches(sdf, path, check, "update")
    return T.latest(spark, path, ["user_id"], sdf.schema)


@query("s21_idempotent_upsert", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def s21(spark, sf):
    """Each batch is upserted twice by key, as when it is replayed after a failure."""
    path = work_path(spark, "upserts")
    sdf = T.running_count(streamed(spark, clicks(spark, sf), "event_id"), ["event_type"])

    def step(batch, i):
        for _ in range(2):
            S.upsert(batch, path, ["event_type"])

    T.run_batches(sdf, step, work_path(spark, "checkpoint"), "update")
    return S.keyed_table(spark, path)


@query("s21_once_into_database", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def s21_once(spark, sf):
    """Each batch's own counts are added in a database, twice as when a batch is repeated: the second time is refused."""
    url = database(spark, "once")
    sdf = streamed(spark, clicks(spark, sf), "event_id")

    def step(batch, i):
        for _ in range(2):
            S.commit_jdbc(A.group_count(batch, ["event_type"]), url, "COUNTS", ["event_type"], "s21", i, {}, ["n"], KIND)

    T.run_batches(sdf, step, work_path(spark, "checkpoint"))
    return read_jdbc(spark, url, "COUNTS", {})


@query("b2_stream_text", f"SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT {W1} AS word FROM documents) GROUP BY 1")
def b2(spark, sf):
    path = work_path(spark, "words")
    sdf = streamed(spark, table(spark, sf, "documents"), "doc_id")
    T.run_batches(A.tokens(sdf, "text"), lambda b, i: b.write.mode("overwrite").text(f"{path}/batch_id={i}"), work_path(spark, "checkpoint"))
    return spark.read.text(path).groupBy(F.col("value").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("b7_jdbc_overwrite", TOTALS)
def b7(spark, sf):
    """Each batch's totals take the place of those before in a database table."""
    url = database(spark, "totals")
    sdf = order_totals(spark, sf)
    T.run_batches(sdf, lambda b, i: S.write_jdbc(b, url, "TOTALS", {}, "overwrite"), work_path(spark, "checkpoint"), "complete")
    return read_jdbc(spark, url, "TOTALS", {})


@query("b17_route_topics", "SELECT event_type AS topic, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def b17(spark, sf):
    """Each topic's records go to the table of its name; a batch's folder is replaced when it is repeated."""
    path = work_path(spark, "topics")
    sdf = streamed(spark, clicks(spark, sf).withColumn("topic", F.col("event_type")), "event_id")
    T.run_batches(sdf, lambda b, i: b.write.mode("overwrite").partitionBy("topic").parquet(f"{path}/batch_id={i}"), work_path(spark, "checkpoint"))
    return A.group_count(spark.read.parquet(path), ["topic"])


@query("d4_stream_exclude", f"SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events WHERE user_id NOT IN ({BLACK}) GROUP BY 1")
def d4s(spark, sf):
    sdf = R.exclude(streamed(spark, clicks(spark, sf), "event_id"), blacklist(spark, sf), "user_id")
    return final(spark, T.running_count(sdf, ["user_id"]), ["user_id"])
