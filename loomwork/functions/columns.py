"""Scalar functions as column expressions, and their names for SQL text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from loomwork.sources.records import ACCESS_LOG


def is_not_empty(c: Column) -> Column:
    """False for null, blank, and the word null in any case."""
    return c.isNotNull() & (F.trim(c) != "") & (F.lower(F.trim(c)) != "null")


def non_blank(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def normalize_words(c: Column) -> Column:
    """Lower case, commas and dots away."""
    return F.translate(F.lower(c), ",.", "")


def first_segment(c: Column, sep: str = ";") -> Column:
    return F.split_part(c, F.lit(sep), F.lit(1))


def id_name(identity: Column, name: Column) -> Column:
    return F.concat_ws(":", identity.cast("string"), name)


def json_string(c: Column, field: str) -> Column:
    return F.get_json_object(c, f"$.{field}")


def product_type(info: Column) -> Column:
    """own for product_type 0, third party for all else, missing ones too."""
    return F.when(json_string(info, "product_type") == "0", "own").otherwise("third party")


def area_level(area: Column, levels: dict[str, str], default: str = "E") -> Column:
    out = F.lit(default)
    for name, level in levels.items():
        out = F.when(area == name, level).otherwise(out)
    return out


def format_millis(ms: Column, fmt: str = "yyyyMMdd", minutes: int = 0) -> Column:
    """Milliseconds since 1970 as text in the session's time zone, moved by so many minutes."""
    return F.date_format(F.timestamp_millis(ms + F.lit(minutes * 60_000)), fmt)


def log_field(line: Column, i: int) -> Column:
    return F.regexp_extract(line, ACCESS_LOG, i)


def round2(c: Column) -> Column:
    return F.round(c.cast("decimal(38,6)"), 2)


def to_number(c: Column, kind: str) -> Column:
    return c.try_cast(kind)


def char_class(word: Column) -> Column:
    """0 for a first letter a-z, 1 for A-Z, 2 for all else."""
    code = F.ascii(word)
    return F.when(code.between(97, 122), 0).when(code.between(65, 90), 1).otherwise(2)


def average(values: pd.Series) -> float:
    """Mean of the values that are not null; null for none."""
    return float(values.mean()) if values.notna().any() else None


def register_functions(spark: SparkSession) -> None:
    """first_segment, id_name and is_not_empty as SQL functions of the session, without Python at run time."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION first_segment(s STRING, sep STRING) RETURNS STRING RETURN split_part(s, sep, 1)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION id_name(id STRING, name STRING) RETURNS STRING RETURN concat_ws(':', id, name)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION is_not_empty(s STRING) RETURNS BOOLEAN RETURN coalesce(trim(s) <> '' AND lower(trim(s)) <> 'null', false)")


def register_aggregates(spark: SparkSession) -> None:
    """avg_sal as an aggregate of SQL text."""
    spark.udf.register("avg_sal", F.pandas_udf(average, "double"))
