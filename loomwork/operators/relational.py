"""Filters, joins and set operations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Bits of a Bloom filter at most (4 MB), and bits and probes for each key while there are enough.
BLOOM_BITS, BLOOM_PER_KEY, BLOOM_PROBES = 1 << 25, 10, 7


def date_range(df: DataFrame, col: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows within both bounds; a bound that is None is open. The bounds are plain predicates on the column, so partitions are pruned."""
    if start is not None:
        df = df.where(F.col(col) >= F.lit(start).cast(df.schema[col].dataType))
    if end is not None:
        df = df.where(F.col(col) <= F.lit(end).cast(df.schema[col].dataType))
    return df


def map_labels(df: DataFrame, col: str, mapping: dict[str, int], out: str = "label") -> DataFrame:
    """Labels as numbers; rows with others are dropped."""
    number = F.lit(None).cast("int")
    for name, k in mapping.items():
        number = F.when(F.col(col) == name, k).otherwise(number)
    return df.withColumn(out, number).where(F.col(out).isNotNull())


def exclude(df: DataFrame, listed: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """df without the rows whose key is listed. With a limit the list is broadcast where it has no more keys than that, else joined."""
    keys = listed.select(key).distinct()
    small = limit is not None and keys.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(keys) if small else keys, key, "left_anti")


def bloom_filter(listed: DataFrame, key: str, most: int = BLOOM_BITS) -> np.ndarray:
    """Bits of the listed keys as 64-bit words; 2 to some power of them, `most` at most, however long the list is.

    Tasks set bits of words, and words are joined bit by bit in the shuffle; the driver gets most / 64 words.
    """
    keys = listed.select(key).distinct()
    n = keys.count()
    bits = min(most, 1 << max(6, (BLOOM_PER_KEY * n - 1).bit_length()))
    at = F.explode(F.array(*(F.pmod(a + b * F.lit(i), F.lit(bits)) for i in range(BLOOM_PROBES) for a, b in [_hashes(key)]))).alias("at")
    words = keys.select(at).select((F.col("at") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, CAST(at % 64 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    for r in words.toLocalIterator():
        out[r["word"]] = r["bits"]
    return out.view(np.uint64)


def _hashes(key: str) -> tuple[Column, Column]:
    """Two hashes below 2^31, so that sums of their multiples stay whole numbers in every engine."""
    return tuple(F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(1 << 31)) for i in range(2))


def maybe_listed(spark, key: str, words: np.ndarray) -> Column:
    """Whether a key may be in the filter; surely not where false."""
    shared, bits = spark.sparkContext.broadcast(words), 64 * len(words)

    def probe(a: pd.Series, b: pd.Series) -> pd.Series:
        found = np.ones(len(a), bool)
        for i in range(BLOOM_PROBES):
            at = (a.to_numpy() + b.to_numpy() * i) % bits
            found &= (shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return pd.Series(found)

    return F.pandas_udf(probe, "boolean")(*_hashes(key))


def exclude_filtered(df: DataFrame, listed: DataFrame, key: str, most: int = BLOOM_BITS) -> tuple[DataFrame, Observation]:
    """df without the rows whose key is listed, for lists that are too long to broadcast; rows with a null key stay.

    A Bloom filter of the list, of bounded size, is broadcast. Rows that it rules out go on where they are; only the others are
    joined with the list. The observation has the number of rows that the filter let through in vain, when the result is run.
    """
    maybe = maybe_listed(df.sparkSession, key, bloom_filter(listed, key, most))
    seen = Observation("in_vain")
    marked = df.withColumn("_maybe", maybe)
    rest = marked.where("_maybe").join(listed.select(key).distinct(), key, "left_anti").select(*marked.columns).observe(seen, F.count(F.lit(1)).alias("rows"))
    return marked.where("NOT _maybe").unionByName(rest).drop("_maybe"), seen


def route(df: DataFrame, col: str, routes: dict[str, str], default: str = "other", out: str = "route") -> DataFrame:
    """df with the route of each row; values without one, nulls too, take the default."""
    target: Column = F.lit(default)
    for value, name in routes.items():
        target = F.when(F.col(col) == value, name).otherwise(target)
    return df.withColumn(out, target)
