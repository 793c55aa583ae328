"""Streaming operators with state of their own kind: values, maps and event-time timers by key, kept by RocksDB.

All are for streams on event time with a watermark. Rows reach them folded: equal rows of a task's share of a batch come as one row
with their number, so that a hot key is a few rows of each task and not a third of all rows in one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from math import gcd

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a task that are folded at once.
FOLD = 100_000


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB; the session's own setting comes back."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before is not None else spark.conf.unset(STORE)


def millis(length: str) -> int:
    return pd.Timedelta(length).value // 1_000_000


def fold(sdf: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """Keys and n of sdf, equal keys within a task's share of a batch as one row with the sum of n; a batch frame or a stream."""
    rows = sdf.select(*keys, F.col(n).cast("long").alias(n))
    schema = StructType([*rows.schema.fields[:-1], StructField(n, LongType())])
    arrow = to_arrow_schema(schema)

    def together(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = pa.Table.from_batches(held).group_by(list(keys)).aggregate([(n, "sum")])
        yield from sums.select([*keys, f"{n}_sum"]).rename_columns([*keys, n]).cast(arrow).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= FOLD:
                yield from together(held)
                held, size = [], 0
        if size:
            yield from together(held)

    return rows.mapInArrow(run, schema)


def pane(size: str, slide: str | None) -> str:
    """The longest stretch of time that windows of this size and slide are whole numbers of."""
    return f"{gcd(millis(size), millis(slide or size))} milliseconds"


def pane_count(sdf: DataFrame, keys: Sequence[str], size: str, slide: str | None, late: str) -> DataFrame:
    """Rows by pane (its start, a time) and key: each row is in one pane, whatever the number of windows it is in."""
    counts = sdf.withWatermark("at", late).groupBy(F.window("at", pane(size, slide)).alias("pane"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("pane.start").alias("pane"), *keys, "n")


def windows_of_panes(panes: DataFrame, keys: Sequence[str], size: str, slide: str | None) -> DataFrame:
    """Windows (start_time and end_time as text) of panes with a row for each pane and key: sums of the panes' counts."""
    out = panes.groupBy(F.window("pane", _as_interval(size), _as_interval(slide or size)).alias("w"), *keys).agg(F.sum("n").alias("n"))
    return out.select(*ends(F.col("w")), *keys, "n")


def _as_interval(length: str) -> str:
    return f"{millis(length)} milliseconds"


def ends(w: Column) -> list[Column]:
    """A window's start_time and end_time as text."""
    fmt = "yyyy-MM-dd HH:mm:ss"
    return [F.date_format(w["start"], fmt).alias("start_time"), F.date_format(w["end"], fmt).alias("end_time")]


def closed_windows(sdf: DataFrame, keys: Sequence[str], size: str, slide: str | None, late: str, n: str | None = None) -> DataFrame:
    """Counts (or sums of n) of each window and key, once, when the watermark passes the window's end: append mode.

    Two aggregations follow each other in the stream: rows into panes, closed panes into windows. `w` is the window.
    """
    count = F.sum(n) if n else F.count(F.lit(1))
    panes = sdf.withWatermark("at", late).groupBy(F.window("at", pane(size, slide)).alias("pane"), *keys).agg(count.alias("n"))
    return panes.groupBy(F.window(F.window_time("pane"), _as_interval(size), _as_interval(slide or size)).alias("w"), *keys).agg(F.sum("n").alias("n"))


class _Best(StatefulProcessor):
    """The n best rows of a window so far, largest count first, then smallest key; they go on, ranked, when the window is over."""

    def __init__(self, n: int, columns: list[str]) -> None:
        self.n, self.columns = n, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getListState("best", "item string, count long")

    def _sorted(self, rows) -> list[tuple]:
        return sorted(rows, key=lambda r: (-r[1], len(r[0]) if r[0].isdigit() else 0, r[0]))[: self.n]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(str(i), int(c)) for f in rows for i, c in zip(f["item"], f["n"], strict=True)]
        self.best.put(self._sorted([*self.best.get(), *new]) if self.best.exists() else self._sorted(new))
        self.handle.registerTimer(int(key[1].timestamp() * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = self._sorted(self.best.get())
        self.best.clear()
        yield pd.DataFrame([(key[0], key[1], i, c, r) for r, (i, c) in enumerate(rows, 1)], columns=self.columns)

    def close(self) -> None:
        pass


def _best_of_task(n: int):
    """Rows of a task's share that can be among the n best of their window."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            # null keys are left out here: as a filter of the stream it would reach the source, and their times the watermark no more
            kept = f[f["item"].notna()].sort_values("n", ascending=False, kind="stable")
            kept["least"] = kept.groupby(["start", "end"])["n"].transform(lambda x: x.iloc[: n].min())
            yield kept[kept["n"] >= kept["least"]].drop(columns="least")  # ties of the last one stay

    return run


def window_best(counts: DataFrame, n: int, key: str) -> DataFrame:
    """start_time, end_time, key (text), n and rank of the n first keys of each closed window, by count, then by key; chained to closed_windows().

    State of a window is n rows, whatever the number of keys; keys of digits only are ordered as numbers, null keys are left out.
    """
    rows = counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col(key).cast("string").alias("item"), "n")
    rows = rows.mapInPandas(_best_of_task(n), rows.schema)
    columns = ["start", "end", "item", "n", "rank"]
    ranked = rows.groupBy("start", "end").transformWithStateInPandas(_Best(n, columns), "start timestamp, end timestamp, item string, n long, rank int", "append", "eventTime")
    fmt = "yyyy-MM-dd HH:mm:ss"
    return ranked.select(F.date_format("start", fmt).alias("start_time"), F.date_format("end", fmt).alias("end_time"), F.col("item").alias(key), "n", "rank")


class _EmptyBatches(StatefulProcessor):
    """Count by key that is forgotten after more than `limit` + 1 intervals in a row without the key."""

    def __init__(self, interval: int, limit: int, columns: list[str]) -> None:
        self.interval, self.gap, self.columns = interval, limit + 2, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "last long, n long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found: dict[int, int] = {}
        for f in rows:
            for b, n in zip(f["interval"].tolist(), f["n"].tolist(), strict=True):
                found[b] = found.get(b, 0) + n
        last, total, due = self.total.get() if self.total.exists() else (min(found), 0, None)
        for b in sorted(found):
            if b - last > self.gap:
                total = 0
            if last - b <= self.gap:  # else of a count that is gone
                total, last = total + found[b], max(last, b)
        if due is not None:
            self.handle.deleteTimer(due)
        # no interval before this time is open once the watermark has passed it
        due = (last + self.gap + 1) * self.interval
        self.handle.registerTimer(due)
        self.total.update((last, total, due))
        yield pd.DataFrame([(*key, total, last)], columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.total.clear()
        return iter(())

    def close(self) -> None:
        pass


def count_until_idle(sdf: DataFrame, keys: Sequence[str], interval: str, limit: int, late: str, n: str | None = None) -> DataFrame:
    """Running count by keys, forgotten by the number of empty batches.

    Batches are intervals of event time. A key's counter of empty batches grows with each interval that it is absent from; on an
    empty one after the counter has passed `limit` the count is dropped, and later rows start from zero. Append mode: keys, n (the
    count so far) and last_interval of every key that a micro-batch holds. Rows later than `late` are dropped.
    """
    ms = millis(interval)
    rows = sdf.withColumn("n", F.lit(1) if n is None else F.col(n)).withColumn("at", F.timestamp_millis(F.floor(F.unix_millis("at") / ms) * ms))
    rows = fold(rows, [*keys, "at"]).withWatermark("at", late).withColumn("interval", F.floor(F.unix_millis("at") / ms))
    schema = StructType([*(rows.schema[k] for k in keys), StructField("n", LongType()), StructField("last_interval", LongType())])
    return rows.groupBy(*keys).transformWithStateInPandas(_EmptyBatches(ms, limit, [*keys, "n", "last_interval"]), schema, "append", "eventTime")


class _Listed(StatefulProcessor):
    """Panes of a user's counts, or the mark of a listed user for good; rows go on with the mark.

    All of a user is one value, as each call of the state store costs far more than a few panes, and rows come and go as they are:
    users have few rows each, for which a data frame costs more than all else.
    """

    def __init__(self, pane_ms: int, panes: int, step: int, limit: int, columns: list[str]) -> None:
        self.pane_ms, self.panes, self.step, self.limit, self.columns = pane_ms, panes, step, limit, columns
        self.out = Row(*columns, "listed")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.user = handle.getValueState("user", "listed boolean, panes array<long>, counts array<long>, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows, listed = list(rows), False
        if not rows[0]["white"]:
            listed, panes, counts, due = self.user.get() or (False, [], [], None)
            if not listed:
                new: dict[int, int] = {}
                for r in rows:
                    p = r["ms"] // self.pane_ms
                    new[p] = new.get(p, 0) + r["n"]
                # without panes that no window of a row still to come reaches
                over = timerValues.getCurrentWatermarkInMs() // self.pane_ms - self.panes
                ring = {p: n for p, n in zip(panes, counts, strict=True) if p >= over}
                for p, n in new.items():
                    ring[p] = ring.get(p, 0) + n
                starts = {s for p in new for s in range((p - self.panes) // self.step * self.step + self.step, p // self.step * self.step + 1, self.step)}
                listed = any(sum(ring.get(s + i, 0) for i in range(self.panes)) > self.limit for s in starts)
                if due is not None:
                    self.handle.deleteTimer(due)
                if listed:
                    self.user.update((True, [], [], None))
                else:
                    # a pane that came before may end later than all of this batch
                    due = (max(ring) + 1 + self.panes) * self.pane_ms
                    self.user.update((False, list(ring), list(ring.values()), due))
                    self.handle.registerTimer(due)
        for r in rows:
            yield self.out(*(r[c] for c in self.columns), listed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.user.clear()  # the newest pane is out of reach, and a listed user has no timer
        return iter(())

    def close(self) -> None:
        pass


def blacklisted(sdf: DataFrame, user: str, keep: Sequence[str], size: str, slide: str, limit: int, whitelist: DataFrame, late: str) -> DataFrame:
    """sdf folded to user, at (start of its pane) and the columns of `keep`, with n and whether the user is listed.

    A user with more than `limit` rows in a window is listed for good, from the micro-batch on that fills the window and with all its
    rows; users of the whitelist never are. State of a user is the panes that a window can still reach, and nothing but a mark once
    listed; no earlier rows are read. Rows later than `late` are dropped. Append mode.
    """
    ms = gcd(millis(size), millis(slide))
    rows = sdf.where(F.col(user).isNotNull()).withColumn("n", F.lit(1)).withColumn("at", F.timestamp_millis(F.floor(F.unix_millis("at") / ms) * ms))
    rows = fold(rows, [user, *keep, "at"]).withWatermark("at", late)
    white = whitelist.select(user).distinct().withColumn("white", F.lit(True))
    rows = rows.join(white, user, "left").withColumn("white", F.coalesce("white", F.lit(False))).withColumn("ms", F.unix_millis("at"))
    rows = rows.select(user, *keep, "at", "n", "white", "ms")
    out = StructType([f for f in rows.schema.fields if f.name not in ("white", "at")]).add("listed", "boolean")
    columns = [f.name for f in out.fields[:-1]]
    marked = rows.groupBy(user).transformWithState(_Listed(ms, millis(size) // ms, millis(slide) // ms, limit, columns), out, "append", "eventTime")
    return marked.select(user, *keep, F.timestamp_millis("ms").alias("at"), "n", "listed")
