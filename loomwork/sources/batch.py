"""Batch sources: text lines, delimited files, JSON lines, Parquet and JDBC tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True, schema: StructType | str | None = None) -> DataFrame:
    """Delimited text; separators of several characters are allowed. Without a schema it is inferred."""
    reader = spark.read.option("sep", sep).option("header", header)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.load(path)


def read_jdbc(spark: SparkSession, url: str, name: str, properties: dict[str, str], predicates: list[str] | None = None) -> DataFrame:
    """A database table, in one partition or in one for each predicate."""
    return spark.read.jdbc(url, name, predicates=predicates, properties=properties) if predicates else spark.read.jdbc(url, name, properties=properties)
