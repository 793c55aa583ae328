"""Small hand-made tables for the odd rows: blanks, nulls, ties, bad numbers, keys with separators, shrinking lists."""

from pyspark.sql import functions as F

from loomwork.functions import columns as C
from loomwork.operators import aggregates as A
from loomwork.operators import relational as R
from loomwork.operators import sinks as S
from loomwork.plans import batch
from loomwork.plans.jobs import area_top_products
from loomwork.session import work_path
from loomwork.sources import records as P


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_ties_are_ranked_by_the_key(spark):
    df = spark.createDataFrame([("a", k, 5) for k in (3, 1, 2)] + [("a", 9, 7)], "part string, k int, n int")
    got = A.rank_within(df, ["part"], [F.desc("n"), F.col("k")], 3).orderBy("rank").collect()
    assert [(r["k"], r["rank"]) for r in got] == [(9, 1), (1, 2), (2, 3)]


def test_words_of_blank_lines(spark):
    df = texts(spark, "", "  ", " a b ", "a\tb  c", None)
    assert rows(A.word_count(df, "value")) == [("", 3), ("a", 2), ("b", 2), ("c", 1)]
    assert rows(A.word_count(df, "value", "w2")) == [("a", 2), ("b", 2), ("c", 1)]


def test_salted_keys_keep_their_separators(spark):
    df = spark.createDataFrame([("a_b", 1), ("a_c", 2), ("a_b", 3), ("_", 4)], "k string, v int")
    assert {r["k"]: (r["total"], r["n"]) for r in A.salted_agg(df, "k", "v", 3).collect()} == {"a_b": (4, 2), "a_c": (2, 1), "_": (4, 1)}
    assert {r["k"]: r["top"] for r in A.group_topn(df, "k", "v", 1, salts=3).collect()} == {"a_b": "3", "a_c": "2", "_": "4"}


def test_counts_of_ids_that_hold_each_other(spark):
    df = spark.createDataFrame([("g", 11, "x"), ("g", 1, "x"), ("g", 11, "x"), ("g", 1, "x"), ("g", 11, "x")], "k string, id int, name string")
    assert rows(A.group_concat_counts(df, ["k"], "id", "name")) == [("g", 5, "1:x:2,11:x:3")]


def test_average_skips_nulls(spark):
    C.register_aggregates(spark)
    spark.createDataFrame([("a", 3.0), ("a", None), ("b", None), ("a", 6.0)], "k string, v double").createOrReplaceTempView("sal")
    assert {r["k"]: r["m"] for r in spark.sql("SELECT k, avg_sal(v) AS m FROM sal GROUP BY k").collect()} == {"a": 4.5, "b": None}


def test_product_type_of_odd_json(spark):
    df = texts(spark, '{"product_type": 0}', '{"product_type": "0"}', '{"product_type": 1}', "{}", "", "no json", None)
    got = [r[0] for r in df.select(C.product_type(F.col("value"))).collect()]
    assert got == ["own", "own"] + ["third party"] * 5


def test_visits_of_unknown_cities_vanish(spark):
    visits = spark.createDataFrame([("2024-01-01", 1, 10), ("2024-01-01", 1, 99), ("2024-01-02", None, 10), ("2023-12-31", 1, 10)], "day string, product_id int, city_id int")
    cities = spark.createDataFrame([(10, "c", "ASIA")], "city_id int, city_name string, area string")
    products = spark.createDataFrame([(1, "p", None)], "product_id int, product_name string, info string")
    got = area_top_products(visits, cities, products, 7, "2024-01-01", None).collect()
    assert [(r["task_id"], r["area"], r["product_id"], r["n"], r["city_infos"], r["product_type"], r["rank"]) for r in got] == [(7, "ASIA", 1, 1, "10:c:1", "third party", 1)]


def test_bad_numbers_are_null_and_short_lines_rejected(spark):
    df = texts(spark, "1,2,3.5", "1,x,3", "1,2,y", "1,2", "", "   ", None, "1,2,3,4")
    good, bad = P.reject_malformed(df, ",", 3)
    assert good.count() == 4 and bad.count() == 4
    got = P.parse_order_csv(df).select("province_id", F.col("price").cast("double")).collect()
    assert sorted(((r[0], r[1]) for r in got), key=str) == sorted([(2, 3.5), (None, 3.0), (2, None), (2, 3.0)], key=str)


def test_access_log_ends_where_it_ends(spark):
    line = '1.2.3.4 - u [10/Oct/2000:13:55:36 -0700] "GET /x HTTP/1.1" 200 23'
    got = P.parse_access_log(texts(spark, line, line + " more", " " + line, line[:-3], "", None)).collect()
    assert [(r["ip_address"], r["endpoint"], r["response_code"], r["content_size"]) for r in got] == [("1.2.3.4", "/x", 200, 23)]


def test_a_list_that_shrinks_leaves_no_old_ranks(spark):
    path = work_path(spark, "ranks")
    for part in ([("d1", 1, "a"), ("d1", 2, "b"), ("d2", 1, "c")], [("d1", 1, "b")]):
        S.replace_partition(spark.createDataFrame(part, "day string, rank int, ad string"), path, "day")
    assert rows(spark.read.parquet(path).select("day", "rank", "ad")) == [("d1", 1, "b"), ("d2", 1, "c")]


def test_snapshot_is_replaced_once_for_all_partitions(spark):
    path = work_path(spark, "whole")
    S.replace_snapshot(spark.range(9).repartition(3), path)
    S.replace_snapshot(spark.range(100, 108).repartition(2), path)
    assert [r[0] for r in rows(spark.read.parquet(path))] == list(range(100, 108))


def test_set_of_keys_only_grows(spark):
    path = work_path(spark, "set")
    for part in ([(1,), (2,)], [(2,), (3,), (3,)], []):
        S.add_to_set(spark.createDataFrame(part, "user_id long"), path, "user_id")
    assert rows(spark.read.parquet(path)) == [(1,), (2,), (3,)]


def test_excluding_by_a_key_that_can_be_null(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "user_id long, v string")
    got = {r["v"] for r in R.exclude(df, spark.createDataFrame([(2,), (None,)], "user_id long"), "user_id").collect()}
    assert "a" in got and "b" not in got


def test_separators_are_taken_as_they_stand(spark):
    for sep in ("^", "|", ".", "::", "\\", "$", "\t"):
        lines = texts(spark, sep.join("abc"), sep.join("ab"), sep.join(["a", "", "c"]), sep.join(["a", "b", ""]), sep * 4, "abc", " ", None)
        good, bad = P.reject_malformed(lines, sep, 3)
        # empty fields at the end do not count, those between do
        assert rows(good) == sorted([(sep.join("abc"),), (sep.join(["a", "", "c"]),)]), sep
        assert bad.count() == 6


def test_order_line_without_a_price_is_dropped(spark):
    got = map(tuple, P.parse_order_csv(texts(spark, "1,2,", "1,2,3", "1,,3", "x,y,z", ",,")).collect())
    assert [(r[0], r[1], None if r[2] is None else float(r[2])) for r in sorted(got, key=str)] == [("1", 2, 3.0), ("1", None, 3.0), ("x", None, None)]


def test_whitelist_job_takes_all_users_of_more_than_three_errors(spark, tmp_path):
    """d6 lists users of 4 to 13 errors too; those of the whitelist and of three errors stay out."""
    errors = [(u, "error") for u, n in ((2, 4), (3, 3), (4, 14), (11, 9)) for _ in range(n)] + [(5, "click")] * 20
    spark.createDataFrame(errors, "user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(21,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    assert rows(batch.d6(spark, str(tmp_path))) == [(2,), (4,)]
