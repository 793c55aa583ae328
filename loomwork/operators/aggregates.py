"""Grouped and global aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def tokens(df: DataFrame, col: str, tokenizer: str = "w1") -> DataFrame:
    """word of each token: w1 splits at runs of white space, keeps a leading empty word and drops trailing ones; w2 splits at each white space and drops empty words."""
    if tokenizer == "w1":
        return df.select(F.explode(F.split(F.regexp_replace(col, r"\s+$", ""), r"\s+", -1)).alias("word"))
    return df.select(F.explode(F.split(col, r"\s", -1)).alias("word")).select(F.trim("word").alias("word")).where("word <> ''")


def word_count(df: DataFrame, col: str, tokenizer: str = "w1") -> DataFrame:
    return tokens(df, col, tokenizer).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def group_count(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def size_stats(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.avg(col).alias("avg_size"), F.min(col).alias("min_size"), F.max(col).alias("max_size"))


def total(df: DataFrame, col: str) -> DataFrame:
    """Sum of money, exact to the cent whatever the order of addition."""
    return df.agg(F.sum(F.col(col).cast("decimal(18,2)")).cast("double").alias("total"))


def heavy_keys(df: DataFrame, key: str, more_than: int, cap: int | None = None) -> DataFrame:
    """Keys of more than so many rows; with a cap the first in the order of (count descending, key)."""
    out = group_count(df, [key]).where(F.col("n") > more_than)
    return out.orderBy(F.desc("n"), key).limit(cap) if cap else out


def salted_agg(df: DataFrame, key: str, measure: str, salts: int = 8) -> DataFrame:
    """Sum and count by key in two stages, the first by a salt too, so that a hot key is spread over so many tasks."""
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts))
    part = df.withColumn("_salt", salt).groupBy(key, "_salt").agg(F.sum(measure).alias("s"), F.count(F.lit(1)).alias("c"))
    return part.groupBy(key).agg(F.sum("s").alias("total"), F.sum("c").alias("n"))


def group_concat_counts(df: DataFrame, keys: Sequence[str], identity: str, name: str, out: str = "infos") -> DataFrame:
    """By keys: rows in all, and id:name:count of each distinct id, by id, comma-separated."""
    counts = df.groupBy(*keys, identity, name).agg(F.count(F.lit(1)).alias("c"))
    listed = F.array_sort(F.collect_list(F.struct(identity, name, "c")))
    return counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x[identity].cast("string"), x[name], x["c"].cast("string"))), ",").alias(out))


def group_topn(df: DataFrame, key: str, value: str, n: int, salts: int | None = None) -> DataFrame:
    """By key the n largest values, largest first, repeats kept, comma-separated; with salts the n of each (key, salt) come first."""

    def best(rows: DataFrame, *by: str | Column) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc(value))
        return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)

    rows = df.select(key, value).where(F.col(value).isNotNull())
    if salts:
        rows = best(rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts))), key, "_salt").select(key, value)
    listed = F.sort_array(F.collect_list(value), asc=False)
    return best(rows, key).groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x.cast("string")), ",").alias("top"))


#: Rows that a task holds before it keeps the best of each key only.
HELD = 100_000


def top_partials(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """key and value of rows that can be among the n largest of their key: each task keeps a buffer of n values for each key.

    Buffers are merged as rows arrive, so a task holds n values for each of its keys and HELD rows more; null values are left out.
    """
    rows = df.select(key, value).where(F.col(value).isNotNull())

    def best(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        frame = pa.Table.from_batches(held).to_pandas(types_mapper=pd.ArrowDtype)
        kept = frame.sort_values(value, ascending=False, kind="stable").groupby(key, dropna=False, sort=False).head(n)
        return pa.Table.from_pandas(kept, schema=held[0].schema, preserve_index=False).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= HELD:
                held = [best(held)]
                size = held[0].num_rows // 2  # room for as much again, so that merging stays in proportion
        if held:
            yield best(held)

    return rows.mapInArrow(run, rows.schema)


def merged_topn(df: DataFrame, key: str, value: str, n: int, salts: int = 64) -> DataFrame:
    """As group_topn(), by buffers that tasks merge: what is shuffled is n values of each key and task, merged in two steps."""
    return group_topn(top_partials(df, key, value, n), key, value, n, salts)


def rank_within(df: DataFrame, part: Sequence[str], order: Sequence[Column], n: int, first: int = 1, out: str = "rank") -> DataFrame:
    """The first n rows of each part in a total order, numbered from `first`."""
    number = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    return df.withColumn(out, number).where(F.col(out) <= n).withColumn(out, F.col(out) - 1 + first)


def observe_counts(df: DataFrame, col: str, name: str = "rows") -> tuple[DataFrame, Observation]:
    """df, and counters of its rows and of the blank values of a column, filled when df is run."""
    seen = Observation(name)
    return df.observe(seen, *counters(col)), seen


def counters(col: str) -> list[Column]:
    """Number of rows, and of those with a blank value."""
    return [F.count(F.lit(1)).alias("rows"), F.count_if(F.trim(F.col(col)) == "").alias("blank")]
