"""Stream sources."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_lines(spark: SparkSession, fmt: str = "socket", **options: object) -> DataFrame:
    """Lines of a stream as `value`: a socket (host, port), or text files of a folder (fmt text, path)."""
    path = options.pop("path", None)
    reader = spark.readStream.format(fmt).options(**options)
    return reader.load(path) if path else reader.load()


def stream_table(spark: SparkSession, path: str, schema, files_per_trigger: int | None = 1) -> DataFrame:
    """Parquet files of a folder as a stream, at most so many files a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def topic_options(servers: str, topics: list[str], starting: str | dict = "latest", per_trigger: int | None = None) -> dict[str, str]:
    """Options of the Kafka source; starting is latest, earliest, or {topic: {partition: offset}}."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics)}
    out["startingOffsets"] = starting if isinstance(starting, str) else json.dumps({t: {str(p): o for p, o in parts.items()} for t, parts in starting.items()})
    if per_trigger:
        out["maxOffsetsPerTrigger"] = str(per_trigger)
    return out


def stream_topic(spark: SparkSession, servers: str, topics: list[str], starting: str | dict = "latest", per_trigger: int | None = None) -> DataFrame:
    """Messages of Kafka topics: topic, partition, offset, key, value as text. Needs the Kafka connector."""
    raw = spark.readStream.format("kafka").options(**topic_options(servers, topics, starting, per_trigger)).load()
    return raw.select("topic", "partition", "offset", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
