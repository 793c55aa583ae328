"""Queries of the machine-learning operators."""

from __future__ import annotations

import uuid

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators import ml as M
from loomwork.operators import relational as R
from loomwork.operators import sinks as S
from loomwork.plans.batch import RATINGS, ratings
from loomwork.session import table, work_path

QUERIES: dict = {}
ORACLES: dict = {}
LABELS = {"en": 0, "de": 1, "fr": 2, "es": 3}
LABEL_SQL = "CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rated(spark, sf) -> DataFrame:
    """The ratings in a table by user: they are joined and moved once, for the means, the fit, which reads them twice, and the scores."""
    name = f"ratings_{uuid.uuid4().hex}"
    rows = ratings(spark, sf).select(F.col("user_id").cast("int"), F.col("item_id").cast("int"), "rating")
    S.save_bucketed(rows, name, "user_id", max(S.BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.table(name)


def fitted(spark, sf, iterations: int = 3, rows: DataFrame | None = None) -> ALSModel:
    known = rated(spark, sf) if rows is None else rows
    return M.fit_als(known.groupBy("user_id", "item_id").agg(F.avg("rating").alias("rating")), 8, iterations, known=known.count())


def labelled(spark, sf) -> DataFrame:
    return R.map_labels(table(spark, sf, "documents"), "lang", LABELS)


@query("k1_als_score")
def k1(spark, sf):
    rows = rated(spark, sf)
    return M.score(fitted(spark, sf, rows=rows), rows)


@query("k2_factors")
def k2(spark, sf):
    model = fitted(spark, sf)
    return model.userFactors.select(F.lit("user").alias("side"), "id", "features").union(model.itemFactors.select(F.lit("item"), "id", "features"))


@query("k3_recommend")
def k3(spark, sf):
    return M.recommend(fitted(spark, sf), 10)


@query("k5_rmse_mse", f"SELECT sqrt(avg((25 - rating) * (25 - rating))) AS rmse, avg((25 - rating) * (25 - rating)) AS mse FROM {RATINGS}")
def k5(spark, sf):
    return M.rmse_mse(ratings(spark, sf).withColumn("prediction", F.lit(25.0)))


@query("k6_save_load")
def k6(spark, sf):
    path, model = work_path(spark, "als"), fitted(spark, sf)
    model.save(path)
    return M.recommend(ALSModel.load(path), 3, "item")


@query("k7_tf_idf", "SELECT doc_id, word, tf, df FROM (SELECT *, CAST(count(*) OVER (PARTITION BY word) AS BIGINT) AS df FROM (SELECT doc_id, word, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(string_split_regex(replace(replace(lower(text), ',', ''), '.', ''), '[ \\t\\n\\x0B\\f\\r]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1, 2))")
def k7(spark, sf):
    return M.tf_idf(table(spark, sf, "documents"), "doc_id", "text")


@query("k8_labels", f"SELECT doc_id, {LABEL_SQL} AS label FROM documents WHERE lang IN ('en', 'de', 'fr', 'es')")
def k8(spark, sf):
    return labelled(spark, sf).select("doc_id", "label")


@query("k9_split", "SELECT doc_id, CAST(concat('0x', substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 1000 < 800 AS train FROM documents")
def k9(spark, sf):
    train, test = M.split(table(spark, sf, "documents"), "doc_id")
    return train.select("doc_id", F.lit(True).alias("train")).union(test.select("doc_id", F.lit(False)))


@query("k10_naive_bayes")
def k10(spark, sf):
    train, test = M.split(labelled(spark, sf), "doc_id")
    return M.accuracy(M.classify(M.fit_text(train, 1 << 14), test))


@query("k11_confusion", f"SELECT {LABEL_SQL} AS label, doc_id % 4 AS prediction, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1, 2")
def k11(spark, sf):
    return M.confusion(labelled(spark, sf).withColumn("prediction", F.col("doc_id") % 4))


@query("k12_classify_saved")
def k12(spark, sf):
    path = work_path(spark, "bayes")
    docs = labelled(spark, sf)
    M.fit_text(M.split(docs, "doc_id")[0], 1 << 14).save(path)
    return M.classify(M.PipelineModel.load(path), docs).select("doc_id", F.element_at(F.array(*(F.lit(x) for x in LABELS)), F.col("prediction").cast("int") + 1).alias("lang"))


@query("k13_word2vec")
def k13(spark, sf):
    return M.nearest_words(M.word_vectors(table(spark, sf, "documents"), "doc_id"), ["the"])
