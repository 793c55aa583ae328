"""Small helpers shared by the operators: shared storage, loop cut-offs and connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a table of sources that is broadcast at most.
SOURCES = 10_000
#: Rows of a table of one or two numbers that is broadcast at most: 16 MB of data.
IDS = 1_000_000
#: Bytes of a batch of rows with texts that a Python worker gets at once.
TEXT_BATCH = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh local one where it is unset (tests).

    Without the setting an error is raised where executors run on other machines, as they would not see that folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomwork-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table of its own in the shared folder and read it back: lost executors lose none of it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    for made in _watched:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Lists that get the path of every table that is written while watching().
_watched: list[list[str]] = []


@contextmanager
def watching() -> Iterator[list[str]]:
    """The paths of the tables that materialize() writes inside."""
    made: list[str] = []
    _watched.append(made)
    try:
        yield made
    finally:
        _watched.remove(made)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables by path; those that are gone already are passed over."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by materialize() that no later plan reads."""
    drop_paths(df.sparkSession, list({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of the letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def by_source(rows: DataFrame, table: DataFrame, source: str, key: str) -> DataFrame:
    """rows with the columns of a written table that has one row a source, null too; the table's key goes.

    The table is broadcast where it has no more than SOURCES rows, and joined by source otherwise.
    """
    few = table.limit(SOURCES + 1).count() <= SOURCES
    return rows.join(F.broadcast(table) if few else table, rows[source].eqNullSafe(table[key])).drop(table[key])


def on_ids(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """rows joined on a number with a written table of ids that is short beside them, so that rows need not move.

    The table is broadcast where it has no more than IDS rows, and the join shuffles both sides otherwise.
    """
    few = ids.limit(IDS + 1).count() <= IDS
    return rows.join(F.broadcast(ids) if few else ids, key, how)


def text_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once by bytes, as texts may be of any length; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    digits, unit = re.fullmatch(r"(\d+)([kmgt]?)i?b?", spark.conf.get(name).lower()).groups()
    if int(digits) << 10 * " kmgt".index(unit or " ") > TEXT_BATCH:
        spark.conf.set(name, str(TEXT_BATCH))


def give_back() -> None:
    """Give the memory that a worker has freed back to the machine; it lives on, idle, while others of its executor work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


#: Rows of a batch that are mapped at once.
ROWS = 512


def map_texts(df: DataFrame, text: str, make: Callable[[], Callable[[list[str | None]], dict]], new: str, carried: list[str] | None = None) -> DataFrame:
    """Columns of df (all, or those of `carried`) as they are, and new columns (DDL) from a column of texts.

    make() gives, once for each task, the function from some texts to the values of the new columns by name. What is carried
    stays in Arrow: a column of whole numbers with a null among them would lose digits in pandas. What the function has as `done`
    is called when the task ends.
    """
    text_batches(df.sparkSession)
    kept = df.select(*(F.col(f"`{c}`") for c in (df.columns if carried is None else carried)))
    fields = StructType.fromDDL(new)
    types = {f.name: f.type for f in to_arrow_schema(fields)}
    wide = len(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = values(part.column(wide).to_pylist())
                columns = [*part.columns[:wide], *(pa.array(found[name], kind) for name, kind in types.items())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:wide], *types])
        batch = part = found = columns = None
        getattr(values, "done", bool)()
        give_back()

    rows = df.select(*(F.col(f"`{c}`") for c in kept.columns), F.col(f"`{text}`").alias(fresh(kept, "text")))
    return rows.mapInArrow(run, StructType([*kept.schema.fields, *fields.fields]))


_GAP = re.compile(rb"[ \t\n\v\f\r]")


def byte_pieces(data: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """data in pieces of about `most` bytes that end between words, or longer where a word is."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + most)
        end = gap.end() if gap else len(data)
        yield data[at:end]
        at = end


def text_pieces(texts: list[str | None], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about `most` characters together, a longer text alone."""
    at = size = 0
    for to, text in enumerate(texts):
        if to > at and size >= most:
            yield at, to
            at, size = to, 0
        size += len(text or "")
    if at < len(texts):
        yield at, len(texts)


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = bytes(b in b" \t\n\v\f\r" for b in range(256))
_ODD, _ODDER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(32))) * _ODD
    h = (h ^ (h >> np.uint64(29))) * _ODDER
    return h ^ (h >> np.uint64(32))


def word_hashes(data: bytes, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of data, A-Z lower-cased and ASCII white space apart, and where the words start.

    Eight bytes of all words are taken in at a time, each after a scrambling of what came before, so that words differ
    where any of their bytes do; words of one length of up to eight bytes never share a hash.
    """
    raw = np.frombuffer(data.translate(_LOWER) + bytes(8), np.uint8)
    space = np.frombuffer(data.translate(_SPACE) + b"\1", bool)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    left = ends - starts
    h = mixed(left.astype(np.uint64) + np.uint64(seed << 40))
    lanes = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), (max(0, len(raw) - 7),), (1,))  # the eight bytes from each place on
    at, live = starts, slice(None)
    while len(at):
        lane = lanes[at]
        short = left < 8
        lane[short] &= (np.uint64(1) << (left[short].astype(np.uint64) << np.uint64(3))) - np.uint64(1)
        h[live] = mixed(h[live] ^ lane)
        more = np.flatnonzero(left > 8)
        live = more if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8
    return h, starts


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: edges (a long, b long) -> (node long, component long), component the smallest node.

    Every node takes the smallest label among its neighbours, then the label of its label (pointer jumping), until
    nothing changes. Each round is joins and partial aggregates over written tables, so hubs are split by the
    adaptive skew join and no component is gathered anywhere. Self loops and repeated edges are harmless; an edge with
    a null end is ignored. An empty table gives an empty table.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = materialize(both.select("a", "b").union(both.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        hooked = materialize(hooked, "hooked")
        # what a label's members have seen lowers the label itself, and with it all its members
        lower = hooked.groupBy(F.col("component").alias("root")).agg(F.min("low").alias("root_low"))
        lower = materialize(lower, "roots")
        step = hooked.join(lower, hooked.component == lower.root).select("node", "component", F.least("low", "root_low").alias("low"))
        step = materialize(step, "step")
        jump = step.alias("s").join(step.select(F.col("node").alias("at"), F.col("low").alias("further")).alias("t"), F.col("s.low") == F.col("t.at"), "left")
        jump = jump.select("node", "component", F.least("low", "further").alias("low"))
        jumped = materialize(jump, "jump")
        changed = jumped.where("low <> component").limit(1).count()
        for done in (labels, hooked, lower, step):
            drop_table(done)
        labels = jumped.select("node", F.col("low").alias("component"))
        if not changed:
            drop_table(both)
            return labels
