"""Parsers of text records into columns. Rows that do not fit are dropped, or told apart by reject_malformed()."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the common log format.
ACCESS_LOG = r'^(\S+) (\S+) (\S+) \[([\w:/]+\s[+\-]\d{4})\] "(\S+) (\S+) (\S+)" (\d{3}) (\d+)$'
ACCESS_FIELDS = ["ip_address", "client_id", "user_name", "date_time", "method", "endpoint", "protocol"]


def parse_access_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """The nine fields of each line that has the common log format; other lines are dropped."""
    fields = [F.regexp_extract(col, ACCESS_LOG, i + 1).alias(name) for i, name in enumerate(ACCESS_FIELDS)]
    code, size = (F.regexp_extract(col, ACCESS_LOG, i) for i in (8, 9))
    return lines.where(F.col(col).rlike(ACCESS_LOG)).select(*fields, code.try_cast("int").alias("response_code"), size.try_cast("long").alias("content_size"))


def quoted(sep: str) -> str:
    """The regular expression of a separator that is taken as it stands."""
    return re.escape(sep)


def reject_malformed(lines: DataFrame, sep: str, n: int, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good, rejected): lines of at least n fields that are not blank, and the others. Empty fields at the end of a line do not count."""
    ended = F.regexp_replace(col, rf"(?:{quoted(sep)})+$", "")
    good = (F.length(F.trim(col)) > 0) & (F.length(ended) > 0) & (F.size(F.split(ended, quoted(sep), -1)) >= n)
    good = F.coalesce(good, F.lit(False))
    return lines.where(good), lines.where(~good)


def parse_order_csv(lines: DataFrame, col: str = "value") -> DataFrame:
    """order_id,province_id,price: lines that are not blank and have three fields at least; bad numbers are null."""
    good, _ = reject_malformed(lines, ",", 3, col)
    part = F.split(col, ",", -1)
    return good.select(F.get(part, F.lit(0)).alias("order_id"), F.get(part, F.lit(1)).try_cast("int").alias("province_id"), F.get(part, F.lit(2)).try_cast("decimal(18,2)").alias("price"))


def parse_order_json(lines: DataFrame, col: str = "value") -> DataFrame:
    """order_id, province_id, price, order_type and the text itself; what is no JSON has nulls."""
    order = F.from_json(col, "orderId string, provinceId int, orderPrice decimal(18,2), orderType string")
    return lines.select(order.alias("o"), F.col(col).alias("raw")).select(F.col("o.orderId").alias("order_id"), F.col("o.provinceId").alias("province_id"), F.col("o.orderPrice").alias("price"), F.col("o.orderType").alias("order_type"), "raw")


def parse_ad_click(lines: DataFrame, col: str = "value") -> DataFrame:
    """time in ms, province, city, user and ad of lines with exactly five fields between spaces."""
    part = F.filter(F.split(F.trim(col), " ", -1), lambda x: x != "")
    rows = lines.select(part.alias("p")).where(F.size("p") == 5)
    return rows.select(F.get("p", F.lit(0)).try_cast("long").alias("ms"), F.get("p", F.lit(1)).alias("province"), F.get("p", F.lit(2)).alias("city"), F.get("p", F.lit(3)).try_cast("long").alias("user_id"), F.get("p", F.lit(4)).try_cast("long").alias("ad_id"))


def parse_cells(lines: DataFrame, col: str = "value") -> DataFrame:
    """Records {r, f, q[], v[], t} as cells: rowkey, family, qualifier, value, ts (the record's t; missing is 0)."""
    record = F.from_json(col, "r string, f string, q array<string>, v array<string>, t string")
    rows = lines.select(record.alias("x")).select("x.r", "x.f", "x.t", F.explode(F.arrays_zip(F.col("x.q").alias("q"), F.col("x.v").alias("v"))).alias("c"))
    return rows.select(F.col("r").alias("rowkey"), F.col("f").alias("family"), F.col("c.q").alias("qualifier"), F.col("c.v").alias("value"), F.coalesce(F.col("t").try_cast("long"), F.lit(0)).alias("ts")).where("rowkey IS NOT NULL")


def cells_to_long(rows: DataFrame, key: str, family: str = "info", ts: Column | None = None) -> DataFrame:
    """One cell for each column but the key: rowkey, family, qualifier, value, ts; null values make no cell."""
    named = [c for c in rows.columns if c != key]
    cells = F.array(*(F.struct(F.lit(c).alias("qualifier"), F.col(c).cast("string").alias("value")) for c in named))
    out = rows.select(F.col(key).cast("string").alias("rowkey"), F.lit(family).alias("family"), F.explode(cells).alias("c"), (F.lit(0).cast("long") if ts is None else ts).alias("ts"))
    return out.select("rowkey", "family", "c.qualifier", "c.value", "ts").where("value IS NOT NULL")


def long_to_wide(cells: DataFrame, qualifiers: list[str]) -> DataFrame:
    """One row for each rowkey with the latest value of each qualifier."""
    return cells.groupBy("rowkey").pivot("qualifier", qualifiers).agg(F.max_by("value", "ts"))


def parse_task_params(tasks: DataFrame) -> DataFrame:
    """(task_id, task_param JSON) -> task_id, start_date, end_date, ok; blank or missing dates are null, ok is false for what is no JSON object."""
    param = F.from_json("task_param", "startDate string, endDate string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = tasks.select("task_id", "task_param", param.alias("p"))
    ok = F.col("p").isNotNull() & F.col("p._bad").isNull()
    return rows.select("task_id", blank(F.col("p.startDate")).alias("start_date"), blank(F.col("p.endDate")).alias("end_date"), F.coalesce(ok, F.lit(False)).alias("ok"))
