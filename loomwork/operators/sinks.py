"""Sinks. Table targets are folders of Parquet files; an update writes a new version and then puts it in place of the old one."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Buckets of a table that lies by key.
BUCKETS = 16


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def move_files(spark: SparkSession, source: str, target: str, prefix: str = "") -> None:
    """The files of a folder into another, which is made where it is missing; no folder, nothing to move. Names get the prefix."""
    here, fs = _hadoop(spark, source)
    there = _hadoop(spark, target)[0]
    fs.mkdirs(there)
    if fs.exists(here):
        for status in fs.listStatus(here):
            name = status.getPath().getName()
            if not name.startswith((".", "_")) and not fs.rename(status.getPath(), _hadoop(spark, f"{target}/{prefix}{name}")[0]):
                raise OSError(f"{name} could not be moved to {target}")


def recover(spark: SparkSession, path: str) -> None:
    """After a crash while a table was being replaced: the old version comes back if no version is in its place."""
    here, fs = _hadoop(spark, path)
    aside = _hadoop(spark, f"{path}.old")[0]
    if not fs.exists(here) and fs.exists(aside) and not fs.rename(aside, here):
        raise OSError(f"{path} could not be recovered")


def _put(df: DataFrame, path: str) -> None:
    """df in place of the table at path; one writer of a table at a time."""
    spark = df.sparkSession
    recover(spark, path)
    df.write.mode("overwrite").parquet(f"{path}.new")
    new, fs = _hadoop(spark, f"{path}.new")
    here, aside = _hadoop(spark, path)[0], _hadoop(spark, f"{path}.old")[0]
    # the old version is put aside, not deleted, until the new one is in its place
    if fs.exists(here):
        fs.delete(aside, True)
        if not fs.rename(here, aside):
            raise OSError(f"{path} could not be put aside")
    if not fs.rename(new, here):
        fs.rename(aside, here)
        raise OSError(f"{path} could not be replaced")
    fs.delete(aside, True)


def write_text(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", header).csv(path)


def save_partitioned(df: DataFrame, name: str, by: str, database: str | None = None) -> None:
    """A managed table partitioned by a column; its database is made where it is missing."""
    if database:
        df.sparkSession.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    df.write.mode("overwrite").partitionBy(by).saveAsTable(f"`{database}`.`{name}`" if database else f"`{name}`")


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int = BUCKETS) -> None:
    """A managed table whose rows lie by a hash of the key, sorted; tables of as many buckets join on their keys where they lie."""
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(f"`{name}`")


def write_jdbc(df: DataFrame, url: str, name: str, properties: dict[str, str], mode: str = "append", types: str | None = None) -> None:
    """df into a database table; overwriting keeps the table and empties it. types: columns of a new table, as in DDL, that the dialect maps otherwise."""
    writer = df.write.mode(mode).option("truncate", mode == "overwrite").option("batchsize", 500)
    (writer.option("createTableColumnTypes", types) if types else writer).jdbc(url, name, properties=properties)


def merge_jdbc(df: DataFrame, url: str, name: str, keys: Sequence[str], properties: dict[str, str], types: str | None = None) -> None:
    """Upsert by keys: rows go to a staging table of their own, then one MERGE of the database takes them over, so a repeat changes nothing.

    Of rows of df with one key the greatest is taken. The target is there; types are those of the staging table.
    """
    rest = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else df.distinct()
    stage = f"{name}_{uuid.uuid4().hex[:16]}".upper()
    write_jdbc(rows, url, stage, properties, "errorifexists", types)
    on = " AND ".join(f't."{k}" = s."{k}"' for k in keys)
    sets = f"WHEN MATCHED THEN UPDATE SET {', '.join(f'"{c}" = s."{c}"' for c in rest)} " if rest else ""
    insert = f"INSERT ({', '.join(f'"{c}"' for c in rows.columns)}) VALUES ({', '.join(f's."{c}"' for c in rows.columns)})"
    jvm = df.sparkSession._jvm
    link = jvm.java.sql.DriverManager.getConnection(url, _login(jvm, properties))
    try:
        link.createStatement().executeUpdate(f"MERGE INTO {name} t USING {stage} s ON {on} {sets}WHEN NOT MATCHED THEN {insert}")
    finally:
        link.createStatement().executeUpdate(f"DROP TABLE {stage}")
        link.close()


#: Table of the batches that a database has taken over.
LEDGER = "LOOMWORK_BATCHES"
#: SQLSTATE classes and states that say: the table is there already; the key is there already.
_THERE, _TWICE = ("X0Y32", "42S01", "42P07"), ("23505", "23000")


def _login(jvm, properties: dict[str, str]):
    login = jvm.java.util.Properties()
    for k, v in properties.items():
        login.setProperty(k, v)
    return login


def _state(error) -> str:
    cause = error.java_exception
    while cause is not None and not hasattr(cause, "getSQLState"):
        cause = cause.getCause()
    return cause.getSQLState() if cause is not None else ""


def commit_jdbc(df: DataFrame, url: str, name: str, keys: Sequence[str], job: str, batch: int, properties: dict[str, str], adds: Sequence[str] = (), types: str | None = None) -> bool:
    """Upsert df into a database table once for each batch of a job; whether it was taken over now.

    Executors write the rows to a staging table of the batch; then one transaction of the database notes job and batch in LEDGER
    and merges the rows: columns of `adds` are added to what is there, others replace it. A batch that is noted already is
    refused, so a batch that a stream repeats after a crash changes nothing; a transaction that fails leaves no note. Of rows of df
    with one key the greatest is taken, with sums in place of the columns of `adds`. The target is made where it is missing.
    """
    from py4j.protocol import Py4JJavaError

    spark, jvm = df.sparkSession, df.sparkSession._jvm
    rest = [c for c in df.columns if c not in keys and c not in adds]
    aggs = [F.sum(c).alias(c) for c in adds] + ([F.max(F.struct(*rest)).alias("_r")] if rest else [])
    rows = df.groupBy(*keys).agg(*aggs).select(*keys, *adds, *(["_r.*"] if rest else [])).select(*df.columns) if aggs else df.distinct()
    stage = f"{name}_STAGE_{hash_of(job)}_{batch}".upper()
    link = jvm.java.sql.DriverManager.getConnection(url, _login(jvm, properties))

    def run(sql: str, *past: str) -> bool:
        """Whether the statement went through; states of `past` are no failure."""
        try:
            link.createStatement().executeUpdate(sql)
            return True
        except Py4JJavaError as error:
            if _state(error) not in past:
                raise
            return False

    try:
        run(f"CREATE TABLE {LEDGER} (job VARCHAR(200) NOT NULL, batch BIGINT NOT NULL, PRIMARY KEY (job, batch))", *_THERE)
        noted = link.createStatement().executeQuery(f"SELECT 1 FROM {LEDGER} WHERE job = '{job}' AND batch = {batch}").next()
        if noted:
            return False
        write_jdbc(spark.createDataFrame([], rows.schema), url, name, properties, "append", types)
        write_jdbc(rows, url, stage, properties, "overwrite", types)
        on = " AND ".join(f't."{k}" = s."{k}"' for k in keys)
        sets = [f't."{c}" + s."{c}"' if c in adds else f's."{c}"' for c in (*adds, *rest)]
        update = f"WHEN MATCHED THEN UPDATE SET {', '.join(f'"{c}" = {v}' for c, v in zip((*adds, *rest), sets, strict=True))} " if sets else ""
        insert = f"INSERT ({', '.join(f'"{c}"' for c in rows.columns)}) VALUES ({', '.join(f's."{c}"' for c in rows.columns)})"
        link.setAutoCommit(False)
        done = run(f"INSERT INTO {LEDGER} VALUES ('{job}', {batch})", *_TWICE)  # another attempt of the batch may have been first
        if done:
            run(f"MERGE INTO {name} t USING {stage} s ON {on} {update}WHEN NOT MATCHED THEN {insert}")
        link.commit()
        run(f"DROP TABLE {stage}")
        link.commit()
        return done
    except BaseException:
        if not link.getAutoCommit():
            link.rollback()
        raise
    finally:
        link.close()


def hash_of(text: str) -> int:
    """A number of a text that is the same in every process."""
    return zlib.crc32(text.encode())


#: Name of the file that says how many there are.
MARK = "_buckets-"


def upsert(df: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Rows of df take the place of those with the same keys; of rows of df with one key the greatest stays.

    The table is partitioned by a hash of its keys, and only the buckets that df has rows of are written anew; read it with
    keyed_table(). The new buckets are written aside as a whole, then put in place: after a crash between the two they are put
    in place by the next call. The number of buckets is fixed by the first call; one writer at a time.
    """
    spark = df.sparkSession
    rest = [c for c in df.columns if c not in keys]
    new = df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, "_r.*").select(*df.columns) if rest else df.distinct()
    _finish(spark, path)
    here, fs = _hadoop(spark, path)
    if fs.exists(here):
        named = [f.getPath().getName() for f in fs.listStatus(here)]
        buckets = next(int(x.removeprefix(MARK)) for x in named if x.startswith(MARK))
    else:
        new.limit(0).coalesce(1).write.parquet(f"{path}/_bucket=0")
        fs.createNewFile(_hadoop(spark, f"{path}/{MARK}{buckets}")[0])
    new = new.withColumn("_bucket", F.pmod(F.xxhash64(*(F.col(k) for k in keys)), F.lit(buckets)).cast("int"))
    touched = [r["_bucket"] for r in new.select("_bucket").distinct().collect()]  # at most as many as buckets
    there = [f"{path}/_bucket={b}" for b in touched if exists(spark, f"{path}/_bucket={b}")]
    if there:
        old = spark.read.option("basePath", path).parquet(*there)
        on = [old[k].eqNullSafe(new[k]) for k in keys]
        new = old.join(new, on, "left_anti").select(*new.columns).union(new)
    if touched:
        new.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}.next")
        _finish(spark, path)


def _finish(spark: SparkSession, path: str) -> None:
    """Puts buckets that were written aside as a whole in place; those of a write that did not end go."""
    aside, fs = _hadoop(spark, f"{path}.next")
    if not fs.exists(aside):
        return
    if exists(spark, f"{path}.next/_SUCCESS"):
        for status in fs.listStatus(aside):
            name = status.getPath().getName()
            if name.startswith("_bucket="):
                here = _hadoop(spark, f"{path}/{name}")[0]
                fs.delete(here, True)
                if not fs.rename(status.getPath(), here):
                    raise OSError(f"{name} of {path} could not be replaced")
    fs.delete(aside, True)


def keyed_table(spark: SparkSession, path: str) -> DataFrame:
    """What upsert() has made."""
    return spark.read.parquet(path).drop("_bucket")


def replace_partition(df: DataFrame, path: str, by: str) -> None:
    """The partitions that df has rows of are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def replace_snapshot(df: DataFrame, path: str) -> None:
    _put(df, path)


def add_to_set(df: DataFrame, path: str, key: str) -> None:
    """Keys that are not there yet are added; none is removed."""
    spark = df.sparkSession
    keys = df.select(key).distinct()
    if exists(spark, path):
        keys = keys.join(spark.read.parquet(path), key, "left_anti")
    keys.write.mode("append").parquet(path)


def encode_topn(df: DataFrame, keys: Sequence[str], item: str, count: str) -> DataFrame:
    """A row for each key: item:count of its rows, larger counts first, then smaller items, comma-separated."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col(count)).alias("c"), F.col(item).alias("i"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["i"].cast("string"), (-x["c"]).cast("string"))), ",").alias("value"))


def topic_rows(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """key and value as text, as the Kafka sink takes them."""
    return df.select(key.cast("string").alias("key"), value.cast("string").alias("value"))


def write_topic(df: DataFrame, servers: str, topic: str) -> None:
    """key and value rows to a topic. Needs the Kafka connector."""
    df.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def write_routes(df: DataFrame, path: str, by: str = "route") -> None:
    """One partition for each route."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)
