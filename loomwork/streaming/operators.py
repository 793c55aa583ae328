"""Streaming operators on event time. Stateful ones take a stream with an `at` timestamp."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import IntegerType, StructField, StructType, TimestampType

from loomwork.operators import aggregates, sinks
from loomwork.session import work_path
from loomwork.sources.stream import stream_table


def running_total(sdf: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """Total and count by key so far: complete output mode gives all keys each batch, update mode those that changed."""
    return sdf.groupBy(*keys).agg(F.sum(F.col(measure).cast("decimal(18,2)")).cast("double").alias("total"), F.count(F.lit(1)).alias("n"))


def running_count(sdf: DataFrame, keys: Sequence[str]) -> DataFrame:
    return aggregates.group_count(sdf, keys)


def running_count_ttl(sdf: DataFrame, key: str, idle: str, late: str) -> DataFrame:
    """Running count of a text key that starts again from zero when the key was silent for longer than `idle` (event time).

    Rows later than `late` behind the newest are dropped, and a key's state goes when the watermark passes its last row by `idle`.
    Update mode; each changed key gives key, n, last_ms.
    """
    idle_ms = pd.Timedelta(idle).value // 1_000_000

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = sorted(t for b in batches for t in b["ms"])
        n, last = state.get if state.exists else (0, times[0])
        for t in times:
            if last - t <= idle_ms:  # a row from before a silence that is over belongs to a count that is gone
                n, last = (1 if t - last > idle_ms else n + 1), max(t, last)
        state.update((n, last))
        state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [k[0]], "n": [n], "last_ms": [last]})

    rows = sdf.withWatermark("at", late).select(F.col(key).cast("string").alias("key"), F.unix_millis("at").alias("ms"), "at")
    return rows.groupBy("key").applyInPandasWithState(step, "key string, n long, last_ms long", "n long, last_ms long", "update", "EventTimeTimeout")


def run_batches(sdf: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Work off what is there, one foreachBatch call a batch; a checkpoint goes on where it ended."""
    query = sdf.writeStream.outputMode(mode).foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


class BatchCounters(StreamingQueryListener):
    """Counters that a stream observes, by batch: rows (batch, values by name) of the batches that had rows."""

    def __init__(self, name: str) -> None:
        self.name, self.rows, self.ended = name, [], threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None and event.progress.numInputRows:
            self.rows.append((event.progress.batchId, seen.asDict()))

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def count_batches(sdf: DataFrame, col: str, run: Callable[[DataFrame], None], wait: float = 60) -> list[tuple[int, dict]]:
    """Rows, and blank values of a column, of each batch of a stream that run(stream) works off."""
    name, spark = f"counters_{uuid.uuid4().hex}", sdf.sparkSession
    counters = BatchCounters(name)
    spark.streams.addListener(counters)
    try:
        run(sdf.observe(name, *aggregates.counters(col)))
        if not counters.ended.wait(wait):  # events come after the stream has ended
            raise TimeoutError("the stream's last event did not come")
    finally:
        spark.streams.removeListener(counters)
    return counters.rows


def to_console(sdf: DataFrame, checkpoint: str, mode: str = "update", rows: int = 20) -> None:
    """Work off what is there and print the first rows of each batch."""
    query = sdf.writeStream.outputMode(mode).format("console").option("numRows", rows).option("truncate", False).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def keep_batches(sdf: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Each batch's rows with batch_id under a folder of its own, so that a repeated batch replaces itself."""
    run_batches(sdf, lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch_id={i}"), checkpoint, mode)


def latest(spark: SparkSession, path: str, keys: Sequence[str], schema) -> DataFrame:
    """The last batch's row of each key of what keep_batches() kept."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch_id", IntegerType())])).parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")


def slices(df: DataFrame, by: str, n: int) -> str:
    """df as n or more Parquet files by ranges of a column, for a stream whose result does not depend on its batches."""
    path = work_path(df.sparkSession, "slices")
    df.repartitionByRange(n, by).write.parquet(path)
    return path


def slice_of(df: DataFrame, by: str, n: int) -> Column:
    """The slice, from 0, of each row: n ranges of one width between the least and the greatest value of a whole number or a time."""
    value = f"unix_millis(`{by}`)" if isinstance(df.schema[by].dataType, TimestampType) else f"cast(`{by}` AS bigint)"
    ends = df.agg(F.min(F.expr(value)).alias("lo"), F.max(F.expr(value)).alias("hi")).first()
    if ends["lo"] is None:
        return F.lit(0)
    return F.expr(f"coalesce(cast(({value} - {ends['lo']}) * {n} div ({ends['hi']} - {ends['lo']} + 1) AS int), 0)")


def in_order(df: DataFrame, by: str, n: int, run: Callable[[DataFrame], None], last: DataFrame | None = None) -> None:
    """df as a stream of n batches by ranges of a column: a slice arrives when the one before is worked off.

    run(stream) works off what is there, from its checkpoint on. The batches are the same at every run, and no slice goes
    through one task; all slices are written in one pass. The rows of `last` are a slice of their own at the end.
    """
    spark, schema = df.sparkSession, df.schema
    stage, path = work_path(spark, "slices"), work_path(spark, "ordered")
    df.withColumn("_slice", slice_of(df, by, n)).write.partitionBy("_slice").parquet(stage)
    for i in range(n):
        sinks.move_files(spark, f"{stage}/_slice={i}", path, f"slice-{i}-")
        run(stream_table(spark, path, schema, None))
    if last is not None:
        last.write.mode("append").parquet(path)
        run(stream_table(spark, path, schema, None))


def closing_row(df: DataFrame, by: str, after: str) -> DataFrame:
    """One row, null but for a time so much later than all of df that windows that end until then are closed; no row for no df."""
    end = df.agg(F.max(by).alias(by)).where(F.col(by).isNotNull()).select(F.expr(f"`{by}` + INTERVAL '{pd.Timedelta(after).value // 1_000_000_000}' SECOND").alias(by))
    return end.select(*(F.col(by) if f.name == by else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema))
