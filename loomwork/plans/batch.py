"""Queries of the batch operators over the given tables, each with its oracle SQL. Text inputs are rendered by Spark from a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import columns as C
from loomwork.operators import aggregates as A
from loomwork.operators import relational as R
from loomwork.operators import sinks as S
from loomwork.session import table, work_path
from loomwork.sources import batch as B
from loomwork.sources import records as P

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# ------------------------------------------------ renderings, with the same expression in SQL

LOG_SQL = """concat('10.0.0.', user_id % 256, ' - - [01/Jan/2024:00:00:00 +0000] "GET /', event_type, ' HTTP/1.1" ', CASE WHEN event_type = 'error' THEN '404' ELSE '200' END, CASE WHEN event_id % 97 = 0 THEN '' ELSE concat(' ', CAST(floor(value * 100) AS BIGINT)) END)"""
CLICK_SQL = "concat(event_id, ' province_', user_id % 34, ' city_', user_id % 300, '  ', user_id, ' ', event_id % 20, CASE WHEN event_id % 89 = 0 THEN ' x' ELSE '' END)"
ORDER_SQL = "concat(o_orderkey, ',', CASE WHEN o_orderkey % 83 = 0 THEN 'x' ELSE CAST(c_nationkey AS VARCHAR) END, CASE WHEN o_orderkey % 71 = 0 THEN '' ELSE concat(',', CAST(floor(o_totalprice) AS BIGINT)) END)"


def _sql(text: str) -> str:
    return text.replace("VARCHAR", "STRING")


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.expr(_sql(LOG_SQL)).alias("value"))


def click_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.expr(_sql(CLICK_SQL)).alias("value"))


def orders_customers(spark: SparkSession, sf: str) -> DataFrame:
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    return orders.join(customers, orders.o_custkey == customers.c_custkey)


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    return orders_customers(spark, sf).select(F.expr(_sql(ORDER_SQL)).alias("value"))


LOGS = f"(SELECT regexp_extract(v, '^(\\S+) ', 1) AS ip_address, regexp_extract(v, '\"GET (\\S+) ', 1) AS endpoint, CAST(regexp_extract(v, '\" (\\d+) ', 1) AS INT) AS response_code, CAST(regexp_extract(v, ' (\\d+)$', 1) AS BIGINT) AS content_size FROM (SELECT {LOG_SQL} AS v FROM events WHERE event_id % 97 <> 0))"
CLICKS = "(SELECT CAST(event_id AS BIGINT) AS ms, concat('province_', user_id % 34) AS province, concat('city_', user_id % 300) AS city, user_id, event_id % 20 AS ad_id FROM events WHERE event_id % 89 <> 0)"
OC = "orders JOIN customer ON o_custkey = c_custkey"
RATINGS = "(SELECT o_custkey AS user_id, l_partkey AS item_id, l_quantity AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("rating"))


def database(spark: SparkSession, name: str) -> str:
    """Address of a database: that of loomwork.jdbc.url, or one in the memory of this process, for local sessions, with a name of its own."""
    url = spark.conf.get("loomwork.jdbc.url", None)
    if not url and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set loomwork.jdbc.url to a database that all executors reach")
    return url or f"jdbc:derby:memory:{name}_{uuid.uuid4().hex};create=true"


# ------------------------------------------------ A: sources

@query("a7_read_jdbc", "SELECT n_regionkey, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY 1")
def a7(spark, sf):
    """A table written to a database and read back in one partition for each predicate, and whole."""
    url = database(spark, "nations")
    S.write_jdbc(table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), url, "NATIONS", {}, "overwrite")
    parts = B.read_jdbc(spark, url, "NATIONS", {}, ['"n_regionkey" < 2', '"n_regionkey" >= 2'])
    return A.group_count(parts.join(B.read_jdbc(spark, url, "NATIONS", {}), ["n_nationkey", "n_regionkey"]), ["n_regionkey"])



@query("a1_lines", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(length(event_type)) AS BIGINT) AS chars FROM events")
def a1(spark, sf):
    path = work_path(spark, "lines")
    S.write_text(table(spark, sf, "events").select("event_type"), path)
    return B.read_lines(spark, path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("chars"))


@query("a2_delimited_inferred", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def a2(spark, sf):
    path = work_path(spark, "nation")
    S.write_delimited(table(spark, sf, "nation"), path, "\t")
    return B.read_delimited(spark, path, "\t")


@query("a3_delimited_schema", "SELECT p_partkey, p_name, p_size FROM part")
def a3(spark, sf):
    path = work_path(spark, "part")
    S.write_delimited(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), path, "^", header=False)
    return B.read_delimited(spark, path, "^", header=False, schema="p_partkey BIGINT, p_name STRING, p_size INT")


@query("a4_delimited_long_separator", f"SELECT user_id, item_id, CAST(rating AS BIGINT) AS rating FROM {RATINGS}")
def a4(spark, sf):
    path = work_path(spark, "ratings")
    S.write_text(ratings(spark, sf).select(F.concat_ws("::", "user_id", "item_id", F.col("rating").cast("long")).alias("value")), path)
    return B.read_delimited(spark, path, "::", header=False, schema="user_id BIGINT, item_id BIGINT, rating BIGINT")


@query("a5_parquet", "SELECT r_regionkey, r_name FROM region")
def a5(spark, sf):
    return B.read_parquet(spark, f"{sf}/region.parquet")


@query("a6_json", "SELECT event_id, event_type, user_id FROM events")
def a6(spark, sf):
    path = work_path(spark, "json")
    table(spark, sf, "events").select("event_id", "event_type", "user_id").write.json(path)
    return B.read_json(spark, path)


@query("a8_catalog", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def a8(spark, sf):
    name = f"orders_{uuid.uuid4().hex}"
    table(spark, sf, "orders").write.saveAsTable(name)
    return spark.sql(f"SELECT o_orderstatus, count(*) AS n FROM {name} GROUP BY o_orderstatus")


@query("a9_access_log", f"SELECT ip_address, endpoint, response_code, content_size FROM {LOGS}")
def a9(spark, sf):
    return P.parse_access_log(log_lines(spark, sf)).select("ip_address", "endpoint", "response_code", "content_size")


@query("a10_literal_rows", "SELECT event_type, weight, CAST(count(*) AS BIGINT) AS n FROM events JOIN (VALUES ('click', 1), ('view', 2), ('error', 3)) w(event_type, weight) USING (event_type) GROUP BY 1, 2")
def a10(spark, sf):
    weights = spark.createDataFrame([("click", 1), ("view", 2), ("error", 3)], "event_type STRING, weight INT")
    return A.group_count(table(spark, sf, "events").join(weights, "event_type"), ["event_type", "weight"])


CELLS = "(SELECT CAST(c_custkey AS VARCHAR) AS rowkey, u.q AS qualifier, u.v AS value FROM (SELECT c_custkey, unnest([{'q': 'c_name', 'v': c_name}, {'q': 'c_nationkey', 'v': CAST(c_nationkey AS VARCHAR)}, {'q': 'c_mktsegment', 'v': c_mktsegment}]) AS u FROM customer))"


def customer_cells(spark, sf):
    return P.cells_to_long(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "c_custkey")


@query("a11_cells", f"SELECT rowkey, concat('info:', qualifier) AS name, value FROM {CELLS}")
def a11(spark, sf):
    return customer_cells(spark, sf).select("rowkey", F.concat_ws(":", "family", "qualifier").alias("name"), "value")


@query("a11_cells_wide", "SELECT CAST(c_custkey AS VARCHAR) AS rowkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def a11w(spark, sf):
    return P.long_to_wide(customer_cells(spark, sf), ["c_name", "c_nationkey"])


TASK = "concat('{\"startDate\": \"', CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE '1997-01-01' END, '\"', CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '}' END)"


@query("a12_task_params", "SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN '1997-01-01' END AS start_date, o_orderkey % 5 <> 0 AS ok FROM orders")
def a12(spark, sf):
    tasks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.expr(TASK).alias("task_param"))
    out = P.parse_task_params(tasks)
    return out.select("task_id", F.when(F.col("ok"), F.col("start_date")).alias("start_date"), "ok")


@query("a18_order_csv", "SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CASE WHEN o_orderkey % 83 <> 0 THEN c_nationkey END AS province_id, CAST(CAST(floor(o_totalprice) AS BIGINT) AS DOUBLE) AS price FROM " + OC + " WHERE o_orderkey % 71 <> 0")
def a18(spark, sf):
    return P.parse_order_csv(order_lines(spark, sf)).withColumn("price", F.col("price").cast("double"))


@query("a19_order_json", f"SELECT CAST(o_orderkey AS VARCHAR) AS order_id, c_nationkey AS province_id, CAST(floor(o_totalprice) AS DOUBLE) AS price FROM {OC}")
def a19(spark, sf):
    lines = orders_customers(spark, sf).select(F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("orderId"), F.col("c_nationkey").alias("provinceId"), F.floor("o_totalprice").alias("orderPrice"))).alias("value"))
    return P.parse_order_json(lines).select("order_id", "province_id", F.col("price").cast("double").alias("price"))


@query("a20_ad_click", f"SELECT ms, province, city, user_id, ad_id FROM {CLICKS}")
def a20(spark, sf):
    return P.parse_ad_click(click_lines(spark, sf))


@query("a21_record_cells", f"SELECT rowkey, qualifier, value FROM {CELLS} WHERE qualifier <> 'c_nationkey'")
def a21(spark, sf):
    customer = table(spark, sf, "customer")
    record = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("r"), F.lit("info").alias("f"), F.array(F.lit("c_name"), F.lit("c_mktsegment")).alias("q"), F.array("c_name", "c_mktsegment").alias("v")))
    return P.parse_cells(customer.select(record.alias("value"))).select("rowkey", "qualifier", "value")


# ------------------------------------------------ B: sinks


@query("b3_write_delimited", "SELECT r_regionkey, r_name FROM region")
def b3(spark, sf):
    path = work_path(spark, "region")
    S.write_delimited(table(spark, sf, "region"), path)
    return B.read_delimited(spark, path, schema="r_regionkey INT, r_name STRING")


@query("b4_partitioned_table", "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def b4(spark, sf):
    name = f"orders_{uuid.uuid4().hex}"
    S.save_partitioned(table(spark, sf, "orders"), name, "o_orderpriority", "loomwork")
    return A.group_count(spark.table(f"loomwork.{name}").where("o_orderpriority = '1-URGENT'"), ["o_orderpriority"])


@query("b5_table_ddl", "SELECT n_nationkey, n_name FROM nation")
def b5(spark, sf):
    path = work_path(spark, "ddl")
    S.write_delimited(table(spark, sf, "nation").select("n_nationkey", "n_name"), path, "\t", header=False)
    name = f"nation_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (n_nationkey INT, n_name STRING) USING csv OPTIONS (path '{path}', sep '\t')")
    return spark.table(name)


@query("b6_jdbc_append", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1 UNION ALL SELECT event_type, CAST(count(*) AS BIGINT) FROM events GROUP BY 1")
def b6(spark, sf):
    url, events = database(spark, "appended"), table(spark, sf, "events")
    for part in (events.where("event_id % 2 = 0"), events):
        S.write_jdbc(A.group_count(part, ["event_type"]), url, "COUNTS", {}, "append", KIND)
    return B.read_jdbc(spark, url, "COUNTS", {})


KIND = "event_type VARCHAR(64)"


@query("b8_jdbc_merge", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def b8_jdbc(spark, sf):
    """Counts of one half are there; those of all rows are merged over them, twice as after a lost acknowledgement."""
    url, events = database(spark, "merged"), table(spark, sf, "events")
    S.write_jdbc(A.group_count(events.where("event_id % 2 = 0 AND event_type <> 'click'"), ["event_type"]), url, "COUNTS", {}, "overwrite", KIND)
    for _ in range(2):
        S.merge_jdbc(A.group_count(events, ["event_type"]), url, "COUNTS", ["event_type"], {}, KIND)
    return B.read_jdbc(spark, url, "COUNTS", {})


@query("b8_upsert", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def b8(spark, sf):
    path, events = work_path(spark, "upsert"), table(spark, sf, "events")
    S.upsert(A.group_count(events.where("event_id % 2 = 0"), ["event_type"]), path, ["event_type"])
    for _ in range(2):
        S.upsert(A.group_count(events, ["event_type"]), path, ["event_type"])
    return S.keyed_table(spark, path)


@query("b9_replace_partition", "SELECT event_type, CAST(max(user_id) + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS BIGINT) AS top_user FROM events GROUP BY event_type")
def b9(spark, sf):
    path = work_path(spark, "replace")
    top = table(spark, sf, "events").groupBy("event_type").agg(F.max("user_id").alias("top_user"))
    S.replace_partition(top, path, "event_type")
    S.replace_partition(top.where("event_type = 'click'").withColumn("top_user", F.col("top_user") + 1), path, "event_type")
    return spark.read.schema("top_user BIGINT, event_type STRING").parquet(path)


@query("b10_replace_snapshot", "SELECT DISTINCT user_id FROM events WHERE event_type = 'error'")
def b10(spark, sf):
    path, events = work_path(spark, "snapshot"), table(spark, sf, "events")
    S.replace_snapshot(events.select("user_id").distinct(), path)
    S.replace_snapshot(events.where("event_type = 'error'").select("user_id").distinct(), path)
    return spark.read.parquet(path)


@query("b11_hash_field", f"SELECT c_nationkey AS province, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM {OC} GROUP BY 1")
def b11(spark, sf):
    path = work_path(spark, "fields")
    totals = orders_customers(spark, sf).groupBy(F.col("c_nationkey").alias("province")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    S.upsert(totals, path, ["province"])
    return S.keyed_table(spark, path)


TOP_ADS = f"(SELECT province, ad_id, n, row_number() OVER (PARTITION BY province ORDER BY n DESC, ad_id) AS r FROM (SELECT province, ad_id, CAST(count(*) AS BIGINT) AS n FROM {CLICKS} GROUP BY 1, 2))"


def province_ads(spark, sf):
    return A.group_count(P.parse_ad_click(click_lines(spark, sf)), ["province", "ad_id"])


def top_ads(spark, sf, first=1):
    return A.rank_within(province_ads(spark, sf), ["province"], [F.desc("n"), F.col("ad_id")], 5, first)


@query("b12_encode_topn", f"SELECT province, string_agg(concat(ad_id, ':', n), ',' ORDER BY n DESC, ad_id) AS value FROM {TOP_ADS} WHERE r <= 5 GROUP BY 1")
def b12(spark, sf):
    return S.encode_topn(top_ads(spark, sf), ["province"], "ad_id", "n")


@query("b13_add_to_set", "SELECT DISTINCT user_id FROM events")
def b13(spark, sf):
    path, events = work_path(spark, "set"), table(spark, sf, "events")
    for part in ("click", "view", None):
        S.add_to_set(events.where(F.col("event_type") == part) if part else events, path, "user_id")
    return spark.read.parquet(path)


@query("b14_topic_rows", f"SELECT CAST(c_nationkey AS VARCHAR) AS key, concat(c_nationkey, ',', count(*)) AS value FROM {OC} GROUP BY c_nationkey")
def b14(spark, sf):
    counts = A.group_count(orders_customers(spark, sf), ["c_nationkey"])
    return S.topic_rows(counts, F.col("c_nationkey"), F.concat_ws(",", "c_nationkey", "n"))


@query("b15_cell_put", f"SELECT rowkey, 'info' AS family, qualifier, CASE WHEN qualifier = 'c_name' THEN upper(value) ELSE value END AS value FROM {CELLS}")
def b15(spark, sf):
    path, cells = work_path(spark, "cells"), customer_cells(spark, sf)
    keys = ["rowkey", "family", "qualifier"]
    S.upsert(cells.drop("ts"), path, keys)
    S.upsert(cells.drop("ts").where("qualifier = 'c_name'").withColumn("value", F.upper("value")), path, keys)
    return S.keyed_table(spark, path)


ROUTES = {"1-URGENT": "alipay", "2-HIGH": "weixin", "3-MEDIUM": "card"}


@query("b16_route", "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'alipay' WHEN '2-HIGH' THEN 'weixin' WHEN '3-MEDIUM' THEN 'card' ELSE 'other' END AS route, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def b16(spark, sf):
    path = work_path(spark, "routes")
    S.write_routes(R.route(table(spark, sf, "orders"), "o_orderpriority", ROUTES), path)
    return A.group_count(spark.read.parquet(path), ["route"])


# ------------------------------------------------ C: projections and filters


@query("c1_select", "SELECT o_orderkey, o_custkey FROM orders")
def c1(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey")


@query("c2_project", "SELECT o_orderkey AS id, o_totalprice * 2 AS double_price FROM orders")
def c2(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_totalprice * 2 AS double_price")


@query("c3_filter", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")
def c3(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_totalprice") > 100000).select("o_orderkey")


@query("c4_date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1998-12-31'")
def c4(spark, sf):
    return R.date_range(table(spark, sf, "orders"), "o_orderdate", "1997-01-01", "1998-12-31").select("o_orderkey")


@query("c5_is_not_empty", "SELECT event_id FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN ' NuLL' WHEN 2 THEN NULL ELSE event_type END AS x FROM events) WHERE x IS NOT NULL AND trim(x) <> '' AND lower(trim(x)) <> 'null'")
def c5(spark, sf):
    x = F.expr("CASE event_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN ' NuLL' WHEN 2 THEN NULL ELSE event_type END")
    return table(spark, sf, "events").where(C.is_not_empty(x)).select("event_id")


@query("c6_non_blank", "SELECT doc_id FROM documents WHERE length(trim(text)) > 0")
def c6(spark, sf):
    return table(spark, sf, "documents").where(C.non_blank(F.col("text"))).select("doc_id")


@query("c7_reject_malformed", f"SELECT o_orderkey % 71 <> 0 AS ok, CAST(count(*) AS BIGINT) AS n FROM {OC} GROUP BY 1")
def c7(spark, sf):
    good, bad = P.reject_malformed(order_lines(spark, sf), ",", 3)
    return A.group_count(good.select(F.lit(True).alias("ok")).union(bad.select(F.lit(False))), ["ok"])


@query("c8_map_labels", "SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS label FROM documents WHERE lang IN ('en', 'de', 'fr')")
def c8(spark, sf):
    return R.map_labels(table(spark, sf, "documents"), "lang", {"en": 0, "de": 1, "fr": 2}).select("doc_id", "label")


# ------------------------------------------------ D: joins


@query("d1_join_using", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def d1(spark, sf):
    region = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return table(spark, sf, "nation").join(region, "n_regionkey").select("n_name", "r_name")


@query("d2_join_on", "SELECT p_name, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def d2(spark, sf):
    lines, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return lines.join(part, lines.l_partkey == part.p_partkey).groupBy("p_name").agg(F.sum("l_quantity").alias("q"))


@query("d2_join_bucketed", "SELECT p_name, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def d2_bucketed(spark, sf):
    """Both tables lie by the key of the join, which therefore moves no row."""
    tag = uuid.uuid4().hex
    S.save_bucketed(table(spark, sf, "lineitem").select("l_partkey", "l_quantity"), f"lines_{tag}", "l_partkey")
    S.save_bucketed(table(spark, sf, "part").select("p_partkey", "p_name"), f"parts_{tag}", "p_partkey")
    lines, part = spark.table(f"lines_{tag}"), spark.table(f"parts_{tag}")
    return lines.join(part.hint("merge"), lines.l_partkey == part.p_partkey).groupBy("p_name").agg(F.sum("l_quantity").alias("q"))


@query("d3_left_join", "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def d3(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return table(spark, sf, "customer").select("c_custkey").join(orders, "c_custkey", "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


#: Users of many errors: about half of all, so that neither the list nor what is left is empty.
BLACK = "SELECT user_id FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) > 13"


def blacklist(spark, sf, limit: int = 13):
    return A.heavy_keys(table(spark, sf, "events").where("event_type = 'error'"), "user_id", limit)


@query("d4_exclude", f"SELECT event_id FROM events WHERE user_id NOT IN ({BLACK})")
def d4(spark, sf):
    return R.exclude(table(spark, sf, "events"), blacklist(spark, sf), "user_id").select("event_id")


@query("d5_exclude_broadcast", f"SELECT event_id FROM events WHERE user_id NOT IN ({BLACK})")
def d5(spark, sf):
    return R.exclude(table(spark, sf, "events"), blacklist(spark, sf), "user_id", limit=100_000).select("event_id")


@query("d5_exclude_filtered", f"SELECT event_id FROM events WHERE user_id NOT IN ({BLACK})")
def d5_filtered(spark, sf):
    return R.exclude_filtered(table(spark, sf, "events"), blacklist(spark, sf), "user_id")[0].select("event_id")


#: Users of more than a few errors, nearly all.
ERRING = "SELECT user_id FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) > 3"


@query("d6_whitelist", f"SELECT DISTINCT user_id FROM ({ERRING}) WHERE user_id % 10 <> 1")
def d6(spark, sf):
    white = table(spark, sf, "customer").where("c_custkey % 10 = 1").select(F.col("c_custkey").alias("user_id"))
    white = white.union(table(spark, sf, "events").where("user_id % 10 = 1").select("user_id"))
    return R.exclude(blacklist(spark, sf, 3).select("user_id"), white, "user_id", limit=100_000)


@query("d7_join_pairs", "SELECT a.l_orderkey, a.l_linenumber, b.l_tax FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 40")
def d7(spark, sf):
    a = table(spark, sf, "lineitem").where("l_quantity > 40").select("l_orderkey", "l_linenumber")
    return a.join(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax"), ["l_orderkey", "l_linenumber"])


# ------------------------------------------------ E: aggregations

W1 = "unnest(string_split_regex(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+$', ''), '[ \\t\\n\\x0B\\f\\r]+'))"


@query("e1_word_count", f"SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT {W1} AS word FROM documents) GROUP BY 1")
def e1(spark, sf):
    return A.word_count(table(spark, sf, "documents"), "text", "w1")


@query("e2_word_count_trimmed", "SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]')) AS word FROM documents) WHERE word <> '' GROUP BY 1")
def e2(spark, sf):
    return A.word_count(table(spark, sf, "documents"), "text", "w2")


@query("e3_group_count", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def e3(spark, sf):
    return A.group_count(table(spark, sf, "events"), ["event_type"])


@query("e4_size_stats", f"SELECT CAST(sum(content_size) AS DOUBLE) / count(*) AS avg_size, min(content_size) AS min_size, max(content_size) AS max_size FROM {LOGS}")
def e4(spark, sf):
    return A.size_stats(P.parse_access_log(log_lines(spark, sf)), "content_size")


@query("e5_total", "SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders")
def e5(spark, sf):
    return A.total(table(spark, sf, "orders"), "o_totalprice")


@query("e6_top_rated", f"SELECT item_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(rating) AS DOUBLE) AS stars FROM {RATINGS} GROUP BY 1 HAVING count(*) > 20 ORDER BY stars DESC, item_id LIMIT 20")
def e6(spark, sf):
    rated = ratings(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("stars"))
    return rated.where("n > 20").orderBy(F.desc("stars"), "item_id").limit(20)


@query("e7_group_avg", "SELECT c_nationkey, CAST(CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(c_acctbal) AS BIGINT) AS avg_sal FROM customer GROUP BY 1")
def e7(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.rint(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double") / F.count("c_acctbal")).cast("long").alias("avg_sal"))


@query("e8_heavy_keys", "SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1 HAVING count(*) > 30 ORDER BY n DESC, user_id LIMIT 20")
def e8(spark, sf):
    return A.heavy_keys(table(spark, sf, "events"), "user_id", 30, 20)


@query("e9_frequent_buyers", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_totalprice > 50000 GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, o_custkey LIMIT 20")
def e9(spark, sf):
    return A.group_count(table(spark, sf, "orders").where("o_totalprice > 50000"), ["o_custkey"]).where("n >= 2").orderBy(F.desc("n"), "o_custkey").limit(20)


TOPN = "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey DESC) AS top FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 3 GROUP BY 1"


@query("e10_list_aggregation", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def e10(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("orders"))


@query("e11_salted_agg", "SELECT event_type, CAST(sum(user_id) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def e11(spark, sf):
    return A.salted_agg(table(spark, sf, "events"), "event_type", "user_id")


@query("e13_avg_udaf", "SELECT c_mktsegment, CAST(avg(c_nationkey) AS DOUBLE) AS mean FROM customer GROUP BY 1")
def e13(spark, sf):
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.avg(F.col("c_nationkey").cast("double")).alias("mean"))


@query("e14_group_concat_counts", f"SELECT r_name, CAST(sum(c) AS BIGINT) AS n, string_agg(concat(n_nationkey, ':', n_name, ':', c), ',' ORDER BY n_nationkey) AS infos FROM (SELECT r_name, n_nationkey, n_name, CAST(count(*) AS BIGINT) AS c FROM {OC} JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3) GROUP BY 1")
def e14(spark, sf):
    return A.group_concat_counts(orders_places(spark, sf), ["r_name"], "n_nationkey", "n_name")


def orders_places(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    rows = orders_customers(spark, sf)
    return rows.join(places, rows.c_nationkey == places.n_nationkey)


@query("e15_roll_up", f"SELECT province, ad_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT province, city, ad_id, count(*) AS n FROM {CLICKS} GROUP BY 1, 2, 3) GROUP BY 1, 2")
def e15(spark, sf):
    cities = A.group_count(P.parse_ad_click(click_lines(spark, sf)), ["province", "city", "ad_id"])
    return cities.groupBy("province", "ad_id").agg(F.sum("n").alias("n"))


@query("e16_observe", "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE trim(text) = '') AS BIGINT) AS n_blank FROM documents")
def e16(spark, sf):
    rows, seen = A.observe_counts(table(spark, sf, "documents"), "text")
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"], seen.get["blank"])], "n_rows BIGINT, n_blank BIGINT")


# ------------------------------------------------ F, G, H: ranking, sorting, sets


@query("f1_rank_within", "SELECT l_suppkey, l_partkey, n, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) AS r FROM (SELECT l_suppkey, l_partkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2)) WHERE r <= 10")
def f1(spark, sf):
    return A.rank_within(A.group_count(table(spark, sf, "lineitem"), ["l_suppkey", "l_partkey"]), ["l_suppkey"], [F.desc("n"), F.col("l_partkey")], 10)


WORDS = f"(SELECT word, CAST(count(*) AS BIGINT) AS n FROM (SELECT {W1} AS word FROM documents) GROUP BY 1)"


@query("g1_sort_desc", f"SELECT word, n FROM {WORDS} ORDER BY n DESC, word")
def g1(spark, sf):
    return A.word_count(table(spark, sf, "documents"), "text").orderBy(F.desc("n"), "word")


@query("g2_bottom_k", f"SELECT word, n FROM {WORDS} ORDER BY n, word LIMIT 10")
def g2(spark, sf):
    return A.word_count(table(spark, sf, "documents"), "text").orderBy("n", "word").limit(10)


@query("g3_top_k", f"SELECT word, n FROM {WORDS} ORDER BY n DESC, word DESC LIMIT 10")
def g3(spark, sf):
    return A.word_count(table(spark, sf, "documents"), "text").orderBy(F.desc("n"), F.desc("word")).limit(10)


@query("g4_top_k_by_count", f"SELECT word, n FROM {WORDS} ORDER BY n DESC, word LIMIT 10")
def g4(spark, sf):
    return A.word_count(table(spark, sf, "documents"), "text").orderBy(F.desc("n"), "word").limit(10)


@query("g5_group_topn", TOPN)
def g5(spark, sf):
    return A.group_topn(table(spark, sf, "orders"), "o_custkey", "o_orderkey", 3)


@query("g6_group_topn_salted", TOPN)
def g6(spark, sf):
    return A.group_topn(table(spark, sf, "orders"), "o_custkey", "o_orderkey", 3, salts=8)


@query("g5_merged_topn", TOPN)
def g5_merged(spark, sf):
    return A.merged_topn(table(spark, sf, "orders"), "o_custkey", "o_orderkey", 3)


@query("g7_top_ads", f"SELECT province, ad_id, n, CAST(r - 1 AS INT) AS rank FROM {TOP_ADS} WHERE r <= 5")
def g7(spark, sf):
    return top_ads(spark, sf, 0)


@query("g8_limit_ordered", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
def g8(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(7).select("o_orderkey")


@query("h1_union", "SELECT event_id FROM events WHERE event_type = 'click' UNION ALL SELECT event_id FROM events WHERE value > 10")
def h1(spark, sf):
    events = table(spark, sf, "events")
    return events.where("event_type = 'click'").unionByName(events.where("value > 10")).select("event_id")


@query("h2_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def h2(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_type").distinct()


# ------------------------------------------------ I: scalar functions


@query("i1_normalize_words", "SELECT doc_id, replace(replace(lower(text), ',', ''), '.', '') AS words FROM documents WHERE lang = 'en'")
def i1(spark, sf):
    return table(spark, sf, "documents").where("lang = 'en'").select("doc_id", C.normalize_words(F.col("text")).alias("words"))


@query("i2_first_segment", "SELECT p_partkey, split_part(concat('colour:', p_name, ';size:', p_size), ';', 1) AS segment FROM part")
def i2(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C.first_segment(F.concat(F.lit("colour:"), "p_name", F.lit(";size:"), F.col("p_size").cast("string"))).alias("segment"))


@query("i3_id_name", "SELECT concat(n_nationkey, ':', n_name) AS id_name FROM nation")
def i3(spark, sf):
    return table(spark, sf, "nation").select(C.id_name(F.col("n_nationkey"), F.col("n_name")).alias("id_name"))


@query("i4_json_string", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def i4(spark, sf):
    return table(spark, sf, "events").select("event_id", C.json_string(F.col("props"), "k").alias("k"))


def part_info():
    return F.when(F.col("p_partkey") % 7 != 0, F.concat(F.lit('{"product_type": "'), (F.col("p_size") % 2).cast("string"), F.lit('"}')))


@query("i5_product_type", "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 AND p_size % 2 = 0 THEN 'own' ELSE 'third party' END AS product_type FROM part")
def i5(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C.product_type(part_info()).alias("product_type"))


LEVELS = {"AFRICA": "A", "AMERICA": "B", "ASIA": "C", "EUROPE": "D"}
LEVEL_SQL = "CASE r_name WHEN 'AFRICA' THEN 'A' WHEN 'AMERICA' THEN 'B' WHEN 'ASIA' THEN 'C' WHEN 'EUROPE' THEN 'D' ELSE 'E' END"


@query("i6_area_level", f"SELECT r_name, {LEVEL_SQL} AS level FROM region")
def i6(spark, sf):
    return table(spark, sf, "region").select("r_name", C.area_level(F.col("r_name"), LEVELS).alias("level"))


@query("i7_format_millis", "SELECT event_id, strftime(to_timestamp(0)::TIMESTAMP + to_seconds(event_id * 3600) + INTERVAL 30 MINUTE, '%Y%m%d') AS day FROM events")
def i7(spark, sf):
    return table(spark, sf, "events").select("event_id", C.format_millis(F.col("event_id") * 3_600_000, minutes=30).alias("day"))


@query("i8_log_field", f"SELECT endpoint, CAST(count(*) AS BIGINT) AS n FROM {LOGS} GROUP BY 1")
def i8(spark, sf):
    lines = log_lines(spark, sf).select(C.log_field(F.col("value"), 6).alias("endpoint")).where("endpoint <> ''")
    return A.group_count(lines, ["endpoint"])


@query("i9_round2", "SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)), 2) AS DOUBLE) AS tax FROM lineitem")
def i9(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C.round2(F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_tax").cast("decimal(4,2)")).cast("double").alias("tax"))


@query("i10_to_number", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(user_id AS VARCHAR) END AS INT) AS number FROM events")
def i10(spark, sf):
    return table(spark, sf, "events").select("event_id", C.to_number(F.expr("CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(user_id AS STRING) END"), "int").alias("number"))


@query("i11_sql_functions", "SELECT n_nationkey, concat(n_nationkey, ':', n_name) AS id_name FROM nation")
def i11(spark, sf):
    C.register_functions(spark)
    table(spark, sf, "nation").createOrReplaceTempView("nation_view")
    return spark.sql("SELECT n_nationkey, id_name(CAST(n_nationkey AS STRING), n_name) AS id_name FROM nation_view WHERE is_not_empty(n_name)")


@query("i12_sql_aggregate", "SELECT c_mktsegment, CAST(avg(c_nationkey) AS DOUBLE) AS mean FROM customer GROUP BY 1")
def i12(spark, sf):
    C.register_aggregates(spark)
    table(spark, sf, "customer").createOrReplaceTempView("customer_view")
    return spark.sql("SELECT c_mktsegment, avg_sal(c_nationkey) AS mean FROM customer_view GROUP BY c_mktsegment")


@query("i13_char_class", f"SELECT CASE WHEN ascii(word) BETWEEN 97 AND 122 THEN 0 WHEN ascii(word) BETWEEN 65 AND 90 THEN 1 ELSE 2 END AS class, CAST(sum(n) AS BIGINT) AS n FROM {WORDS} GROUP BY 1")
def i13(spark, sf):
    words = A.tokens(table(spark, sf, "documents"), "text")
    return A.group_count(words.select(C.char_class(F.col("word")).alias("class")), ["class"])
