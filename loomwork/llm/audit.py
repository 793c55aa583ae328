"""Filter interaction audit: what each of five filters removes, alone and after the others, in every order.

Filters, by the letter of what a document fails: A under 100 words; B distinct words under 80 % of the words; C more than 10 %
of the code points are A-Z; D any of #$%&*|; E a smaller doc_id has the identical text. Words are maximal runs of
[^\\x20\\x09-\\x0D], case-sensitive. A document's failed filters make a mask of five bits, and the report needs no more than the
number of documents (and of good and toxic ones) of each part and mask.

Four bits are of the text alone. The fifth changes as files arrive: the documents are streamed, all files as available-now
micro-batches, and the state of each text (keyed by its sha256) is the smallest doc_id seen, with what hangs on its documents. A
document is counted under its mask with E when it arrives; the one that is the smallest so far is moved to its mask without E, and
when a smaller id arrives, the earlier one's counts are retracted and added under the mask with E again.

The state is a table in the shared folder, one version for each micro-batch, so a repeated batch starts from the version before
and replaces its own rows and changes; a lost executor loses nothing. (A Python call for each text in a state store gave the
same results at 1361 CPU seconds a GB, of 400 allowed.) Micro-batches are a fixed number (BATCHES), so labels and state, which each
of them reads, are read so many times at any size. Tasks fold rows of one document first, minima of a text are taken in each task
before the shuffle, and what meets by text is the rows of two ids at most, whatever the number of its copies.

Rules: a null text is empty, a null lang is the part ''. A null doc_id is neither smaller nor larger than another, so such
documents never fail E and make none fail. Rows that repeat a doc_id and its text count one by one, and none fails E for the
other. A document is good or toxic if any row of labels with its doc_id says so. No document gives no rows. Memory of a task is
bounded by a batch of rows, the distinct words of one text, and the folded rows of FOLD documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm.common import byte_pieces, drop_paths, drop_table, materialize, shared_path, text_batches

LETTERS = "ABCDE"
LATER = 1 << LETTERS.index("E")
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, MARKS = 100, 80, 10, b"#$%&*|"
#: Micro-batches of one audit at most.
BATCHES = 4
#: Documents whose rows a task folds at once.
FOLD = 20_000
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
_UPPER = bytes(range(65, 91))


def text_mask(data: bytes, n_chars: int) -> int:
    """Bits A to D of a text, as UTF-8 and with its number of code points."""
    words, seen = 0, set()
    for piece in byte_pieces(data, PIECE):
        part = piece.split()
        words += len(part)
        seen.update(part)
    upper = len(data) - len(data.translate(None, _UPPER))
    marked = len(data) != len(data.translate(None, MARKS))
    return (words < MIN_WORDS) | (100 * len(seen) < DISTINCT_PERCENT * words) << 1 | (100 * upper > UPPER_PERCENT * n_chars) << 2 | marked << 3


FOLDED = "doc_id long, text_key binary, part string, mask int, n long"


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one doc_id, text and part as one with their number; texts stay behind."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])
    found: dict[tuple, int] = {}

    def out() -> Iterator[pa.RecordBatch]:
        if found:
            ids, keys, parts, masks = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, keys, parts, masks, found.values()), schema, strict=True)], schema=schema)
            found.clear()

    for batch in batches:
        for doc_id, text, part in zip(*(batch.column(i) for i in range(3)), strict=True):
            value = text.as_py() or ""
            data = value.encode()
            key = (doc_id.as_py(), hashlib.sha256(data).digest(), part.as_py(), text_mask(data, len(value)))
            found[key] = found.get(key, 0) + 1
        if len(found) >= FOLD:
            yield from out()
    yield from out()


_HANGS = ["part", "mask", "good", "toxic"]
ROWS = "doc_id long, text_key binary, part string, mask int, good boolean, toxic boolean, n long"
CHANGES = "part string, mask int, good boolean, toxic boolean, change long"


def labelled(docs: DataFrame, flags: DataFrame) -> DataFrame:
    """Folded documents with what labels say of them."""
    # documents without an id are dealt out by their text, and no label is theirs
    docs = docs.withColumn("own", F.coalesce("doc_id", F.xxhash64("text_key", "part"))).withColumn("named", F.col("doc_id").isNotNull())
    found = docs.join(flags.withColumn("has", F.lit(True)), (docs.own == flags.labelled_id) & docs.named, "left")
    false = F.lit(False)
    return found.select("doc_id", "text_key", "part", "mask", F.coalesce("good", false).alias("good"), F.coalesce("toxic", false).alias("toxic"), "n")


def moved(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of the state and rows that are the smallest of their text in this batch, with `old` and whether they are the smallest of all: `first`."""
    named = rows.where("doc_id IS NOT NULL")
    low = named.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"))
    lowest = named.join(low, ["text_key", "doc_id"]).select(*rows.columns)
    both = state.withColumn("old", F.lit(True)).unionByName(lowest.withColumn("old", F.lit(False)))
    return both.withColumn("first", F.col("doc_id") == F.min("doc_id").over(Window.partitionBy("text_key")))


def changes(rows: DataFrame, both: DataFrame) -> DataFrame:
    """What a batch changes in the counters."""
    later = F.col("mask").bitwiseOR(F.lit(LATER))
    came = rows.select("part", F.when(F.col("doc_id").isNull(), F.col("mask")).otherwise(later).alias("mask"), "good", "toxic", F.col("n").alias("change"))
    # the first of a text moves to the mask without E, one that is no longer first moves back
    sign = F.when(F.col("first") & ~F.col("old"), 1).when(~F.col("first") & F.col("old"), -1).otherwise(0)
    turned = both.withColumn("sign", sign).where("sign <> 0")
    turned = turned.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), (F.col("sign") * F.col("n")).alias("change")), F.struct(later.alias("mask"), (-F.col("sign") * F.col("n")).alias("change")))).alias("x"))
    return came.unionByName(turned.select("part", "x.mask", "good", "toxic", "x.change")).groupBy(*_HANGS).agg(F.sum("change").alias("change"))


def flags_of(labels: DataFrame) -> DataFrame:
    """labelled_id, good, toxic of each doc_id of labels."""
    any_of = lambda c: F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias({"quality": "good"}.get(c, c))
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("labelled_id")).agg(any_of("quality"), any_of("toxic"))


def counters(spark: SparkSession, path: str, labels: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """part, mask, good, toxic, n of the documents in the Parquet files under path, written to the shared folder.

    files_per_batch: files of a micro-batch; the default makes BATCHES of all.
    """
    table = spark.read.parquet(path)
    files = table.inputFiles()
    per = files_per_batch or max(1, ceil(len(files) / BATCHES))
    if len(files) == 1 and files[0].rpartition("/")[2] == path.rpartition("/")[2]:
        path = f"{path[:-1]}[{path[-1]}]"  # a stream takes a single file by a pattern only
    text_batches(spark)
    out = shared_path(spark, "changes")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", per).parquet(path)
    flags, base = materialize(flags_of(labels), "flags"), shared_path(spark, "audit")

    def step(batch: DataFrame, i: int) -> None:
        docs = batch.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("lang", F.lit("")).alias("part")).mapInArrow(_documents, FOLDED)
        labelled(docs, flags).write.mode("overwrite").parquet(f"{base}/rows-{i}")
        rows = spark.read.schema(ROWS).parquet(f"{base}/rows-{i}")
        state = spark.read.schema(ROWS).parquet(f"{base}/state-{i - 1}") if i else spark.createDataFrame([], ROWS)
        moved(rows, state).write.mode("overwrite").parquet(f"{base}/moved-{i}")
        both = spark.read.schema(f"{ROWS}, old boolean, first boolean").parquet(f"{base}/moved-{i}")
        both.where("first").drop("old", "first").write.mode("overwrite").parquet(f"{base}/state-{i}")
        changes(rows, both).write.mode("overwrite").parquet(f"{out}/batch_id={i}")
        drop_paths(spark, [f"{base}/moved-{i}", f"{base}/state-{i - 2}", f"{base}/rows-{i - 1}"])

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    drop_table(flags)
    drop_paths(spark, [base])
    return spark.read.schema(CHANGES).parquet(out).groupBy(*_HANGS).agg(F.sum("change").alias("n")).where("n <> 0")


def steps(spark: SparkSession) -> DataFrame:
    """What becomes of the documents of each mask at each step of each order, as 0 or 1, and the mask's share of the Shapley sum: 19,200 rows."""
    rows = []
    for order in permutations(LETTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << LETTERS.index(letter)
            for mask in range(1 << len(LETTERS)):
                fails, gone = bool(mask & bit), bool(mask & before)
                # of the orders of a mask's letters each is first in as many
                share = 120 // mask.bit_count() if fails else 0
                rows.append(("".join(order), step, mask, int(not fails and not gone), int(fails and not gone), int(fails and gone), int(mask == bit), share))
            before |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, mask int, kept int, removed int, redundant int, alone int, share int")


def report(counts: DataFrame) -> DataFrame:
    """The audit's rows from the counters: one for each part, order and step."""
    by_mask = counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    rows = by_mask.join(F.broadcast(steps(counts.sparkSession)), "mask")
    times = lambda flag, c, name: F.sum(F.col(flag) * F.col(c)).alias(name)
    return rows.groupBy("part", "filter_order", "step").agg(
        times("kept", "n", "kept"), times("removed", "n", "removed"), times("redundant", "n", "redundant"), times("alone", "n", "unique_fails"),
        times("removed", "good", "good_lost"), times("removed", "toxic", "toxic_lost"), times("share", "n", "shapley"),
    )


def audit(spark: SparkSession, path: str, labels: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of the documents under path."""
    return report(counters(spark, path, labels, files_per_batch))
