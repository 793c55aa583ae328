"""The ad-click job, whole: click lines in; blacklist, running counts with expiry, daily top ads of provinces and window counts out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import aggregates as A
from loomwork.operators import sinks as S
from loomwork.plans.streams import LIMIT, SIZE, SLICES, SLIDE, clicks, unlisted_sql, windows_sql
from loomwork.session import work_path
from loomwork.sources import records as P
from loomwork.sources.batch import read_jdbc
from loomwork.sources.stream import stream_table
from loomwork.streaming import operators as T
from loomwork.streaming import stateful as W

QUERIES: dict = {}
ORACLES: dict = {}
DIMS = ["day", "province", "city", "ad_id"]
STATE_TYPES = "day VARCHAR(16), province VARCHAR(64), city VARCHAR(64), ad_id BIGINT, click_count BIGINT"
TOP_TYPES = "field VARCHAR(128), value VARCHAR(1024)"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


@dataclass
class AdClickJob:
    """Streams that follow each other, each with a checkpoint of its own; advance() works off what has arrived.

    Lines are parsed and marked by the state of their user (blacklisted()), and go to a table that the stream writes exactly once.
    From there users that are not listed go on, into running counts by day, province, city and ad, which a table takes over by key,
    batch by batch, with the ads of a province's day rolled up and ranked; and into windows of ads, once each is closed. The tables
    of counts and top ads are a database's, by `url` or loomwork.jdbc.url, and where none is named lie by key in the shared folder.
    """

    spark: SparkSession
    whitelist: DataFrame
    url: str = ""
    limit: int = LIMIT
    interval: str = "1 hour"
    empty: int = 10
    windows: tuple[str, str] = ("60 minutes", "30 minutes")
    best: int = 5
    marked: str = field(init=False)
    closed: str = field(init=False)
    kept: str = field(init=False)
    checks: dict[str, str] = field(init=False)

    def __post_init__(self) -> None:
        self.url = self.url or self.spark.conf.get("loomwork.jdbc.url", "")
        self.marked, self.closed, self.kept = work_path(self.spark, "marked"), work_path(self.spark, "windows"), work_path(self.spark, "ads")
        self.checks = {name: work_path(self.spark, f"check-{name}") for name in ("mark", "count", "window")}

    def mark(self, lines: DataFrame) -> None:
        """Lines of five fields, folded to minutes, with the mark of their user."""
        rows = P.parse_ad_click(lines).where("ms IS NOT NULL AND user_id IS NOT NULL AND ad_id IS NOT NULL").withColumn("at", F.timestamp_millis("ms"))
        rows = rows.withColumn("minute", F.date_trunc("minute", "at"))
        marked = W.blacklisted(rows, "user_id", ["province", "city", "ad_id", "minute"], SIZE, SLIDE, self.limit, self.whitelist, "1 day")
        with W.state_on_disk(self.spark):
            sink = marked.writeStream.format("parquet").partitionBy("listed").option("path", self.marked).option("checkpointLocation", self.checks["mark"])
            stream = sink.trigger(availableNow=True).start()
        stream.awaitTermination()

    def passed(self) -> DataFrame:
        """Stream of the marked rows of users that are not listed."""
        schema = "user_id BIGINT, province STRING, city STRING, ad_id BIGINT, minute TIMESTAMP, at TIMESTAMP, n BIGINT, listed BOOLEAN"
        rows = stream_table(self.spark, self.marked, schema, None).where("NOT listed")
        return rows.select(F.col("minute").alias("at"), F.date_format("minute", "yyyyMMdd").alias("day"), "province", "city", "ad_id", "n")

    def put(self, rows: DataFrame, name: str, keys: list[str], job: str, batch: int, types: str) -> None:
        """Rows of a batch take the place of those with the same keys; a repeated batch changes nothing."""
        if self.url:
            S.commit_jdbc(rows, self.url, name, keys, job, batch, {}, types=types)
        else:
            S.upsert(rows, f"{self.kept}/{name}", keys)

    def stored(self, name: str, predicates: list[str] | None = None) -> DataFrame:
        return read_jdbc(self.spark, self.url, name, {}, predicates) if self.url else S.keyed_table(self.spark, f"{self.kept}/{name}")

    def count(self) -> None:
        """Running counts into AD_STATE, then the top ads of the days and provinces that changed into AD_TOP."""
        counts = W.count_until_idle(self.passed(), DIMS, self.interval, self.empty, "1 hour", "n").select(*DIMS, F.col("n").alias("click_count"))

        def step(batch: DataFrame, i: int) -> None:
            batch = batch.persist()
            try:
                self.put(batch, "AD_STATE", DIMS, "ad-state", i, STATE_TYPES)
                # of the state table only what this batch has changed: its days are few
                days = [r["day"] for r in batch.select("day").distinct().collect()]
                if not days:
                    return
                state = self.stored("AD_STATE", [f"\"day\" = '{d}'" for d in days]).where(F.col("day").isin(days))
                changed = state.join(batch.select("day", "province").distinct(), ["day", "province"], "left_semi")
                self.put(self.top(changed), "AD_TOP", ["field"], "ad-top", i, TOP_TYPES)
            finally:
                batch.unpersist()

        with W.state_on_disk(self.spark):
            T.run_batches(counts, step, self.checks["count"])

    def top(self, state: DataFrame) -> DataFrame:
        """field day:province and value ad:count,... of the best ads over all cities."""
        rolled = state.groupBy("day", "province", "ad_id").agg(F.sum("click_count").alias("n"))
        ranked = A.rank_within(rolled, ["day", "province"], [F.desc("n"), F.col("ad_id")], self.best)
        return S.encode_topn(ranked, ["day", "province"], "ad_id", "n").select(F.concat_ws(":", "day", "province").alias("field"), "value")

    def window(self) -> None:
        """Closed windows of ads."""
        rows = W.closed_windows(self.passed(), ["ad_id"], *self.windows, "1 hour", "n")
        with W.state_on_disk(self.spark):
            T.keep_batches(rows.select(*W.ends(F.col("w")), "ad_id", "n"), self.closed, self.checks["window"])

    def advance(self, lines: DataFrame, then: tuple[Callable[[], None], ...]) -> None:
        self.mark(lines)
        for branch in then:
            branch()

    def state(self) -> DataFrame:
        return self.stored("AD_STATE")

    def tops(self) -> DataFrame:
        return self.stored("AD_TOP")

    def closed_windows(self) -> DataFrame:
        return self.spark.read.schema("start_time STRING, end_time STRING, ad_id BIGINT, n BIGINT").parquet(self.closed).drop("batch_id")

    def blacklist(self) -> DataFrame:
        return self.spark.read.schema("user_id BIGINT, listed BOOLEAN").parquet(self.marked).where("listed").select("user_id").distinct()


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Click lines with the time they come at: time in ms, province, city, user, ad; some with a field too many."""
    rows = clicks(spark, sf)
    value = F.concat_ws(" ", F.unix_millis("at"), F.concat(F.lit("province_"), F.col("user_id") % 34), F.concat(F.lit("city_"), F.col("user_id") % 300), "user_id", "ad_id", F.when(F.col("event_id") % 89 == 0, "x"))
    return rows.select(value.alias("value"), "at")


def run(spark: SparkSession, sf: str, closing: str | None, *branches: str) -> AdClickJob:
    """The job over all lines, in slices by time."""
    job = AdClickJob(spark, clicks(spark, sf).where("user_id % 10 = 1").select("user_id").distinct())
    rows, last = lines(spark, sf), None
    if closing:  # a click far behind all, of an ad that no window closes over
        last = T.closing_row(rows, "at", closing).withColumn("value", F.concat_ws(" ", F.unix_millis("at"), F.lit("- - -1 -1")))
    T.in_order(rows, "at", SLICES, lambda sdf: job.advance(sdf.select("value"), tuple(getattr(job, b) for b in branches)), last)
    return job


GOOD = "event_id % 89 <> 0"
KEPT = f"(SELECT strftime(ts, '%Y%m%d') AS day, concat('province_', user_id % 34) AS province, concat('city_', user_id % 300) AS city, ad_id, event_id, ts, epoch_ms(ts) // 3600000 AS hour FROM {unlisted_sql('user_id % 10 = 1', GOOD)})"
#: Counts by hour batches: a key starts from zero after 12 or more empty hours.
STATE = f"""(SELECT day, province, city, ad_id, CAST(count(*) AS BIGINT) AS click_count FROM (
SELECT *, max(run) OVER (PARTITION BY day, province, city, ad_id) AS last FROM (
SELECT *, sum(CASE WHEN hour - before > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY day, province, city, ad_id ORDER BY hour, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
SELECT *, lag(hour) OVER (PARTITION BY day, province, city, ad_id ORDER BY hour, event_id) AS before FROM {KEPT}))) WHERE run = last GROUP BY ALL)"""


@query("j3_state", f"SELECT * FROM {STATE}")
def j3_state(spark, sf) -> DataFrame:
    return run(spark, sf, None, "count").state()


@query("j3_province_top", f"SELECT concat(day, ':', province) AS field, string_agg(concat(ad_id, ':', n), ',' ORDER BY n DESC, ad_id) AS value FROM (SELECT *, row_number() OVER (PARTITION BY day, province ORDER BY n DESC, ad_id) AS r FROM (SELECT day, province, ad_id, CAST(sum(click_count) AS BIGINT) AS n FROM {STATE} GROUP BY ALL)) WHERE r <= 5 GROUP BY ALL")
def j3_province_top(spark, sf) -> DataFrame:
    return run(spark, sf, None, "count").tops()


@query("j3_windows", windows_sql("ad_id", 60, 30, KEPT))
def j3_windows(spark, sf) -> DataFrame:
    return run(spark, sf, "2 days", "window").closed_windows()
