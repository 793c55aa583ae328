"""The learning operators against numpy: factors, recommendations, tf-idf weights, naive Bayes, word neighbours."""

import numpy as np
import pytest
from pyspark.ml.recommendation import ALSModel
from pyspark.sql import functions as F

from loomwork.operators import ml as M
from loomwork.plans import jobs
from loomwork.plans import learning as L
from loomwork.plans.batch import ratings
from loomwork.session import table, work_path


@pytest.fixture(scope="module")
def als(spark, sf):
    return L.fitted(spark, sf, 8)


@pytest.fixture(scope="module")
def factors(als):
    return tuple({r["id"]: np.array(r["features"]) for r in side.collect()} for side in (als.userFactors, als.itemFactors))


def test_scores_are_products_of_factors(spark, sf, als, factors):
    users, items = factors
    pairs = ratings(spark, sf).select(F.col("user_id").cast("int"), F.col("item_id").cast("int"), "rating")
    rows = als.transform(pairs).collect()
    assert len(rows) == pairs.count()
    assert all(abs(r["prediction"] - users[r["user_id"]] @ items[r["item_id"]]) < 1e-3 for r in rows)


def test_scores_are_those_of_the_model(spark, als):
    """Pairs that come twice give two rows, those of an unknown user or item none."""
    users, items = ([r["id"] for r in side.select("id").limit(3).collect()] for side in (als.userFactors, als.itemFactors))
    pairs = [(u, i, 1.0) for u in (*users, users[0], -5) for i in (*items, -7)]
    rows = spark.createDataFrame(pairs, "user_id INT, item_id INT, rating DOUBLE")
    found = M.score(als, rows)
    assert found.columns == als.transform(rows).columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, als.transform(rows).collect())) and found.count() == 12


def test_ratings_are_joined_once(spark, sf):
    """The fit and the scores read one table of ratings that lies by user: scoring joins no lines and does not move rows by user."""
    plan = L.QUERIES["k1_als_score"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan and "rating" in plan


def test_fit_is_closer_than_the_mean(spark, sf, als):
    known = ratings(spark, sf).groupBy("user_id", "item_id").agg(F.avg("rating").alias("rating"))
    scored = als.transform(known.select(F.col("user_id").cast("int"), F.col("item_id").cast("int"), "rating"))
    assert M.rmse_mse(scored).first()["rmse"] < 0.8 * known.agg(F.stddev_pop("rating")).first()[0]


@pytest.mark.parametrize("side", ["user", "item"])
def test_recommendations_are_the_best_of_all(als, factors, side):
    own, others = factors if side == "user" else factors[::-1]
    got = {}
    for r in M.recommend(als, 5, side).collect():
        got.setdefault(r["id"], []).append(r["score"])
    assert got.keys() == own.keys()
    matrix = np.array(list(others.values()))
    for k, scores in got.items():
        assert np.allclose(sorted(scores, reverse=True), np.sort(matrix @ own[k])[::-1][:5], atol=1e-3)


def test_best_products_are_those_of_all_pairs_and_most_pairs_of_blocks_are_not_multiplied(spark, monkeypatch):
    """Zero, negative, equal and few rows; all pairs by numpy. The library's own way made k rows of each pair of blocks."""
    draw = np.random.default_rng(5)
    sides = [(draw.normal(size=(n, 4)) * draw.lognormal(0, 0.8, size=(n, 1))).astype(np.float32) for n in (700, 900)]
    sides[0][3], sides[1][7], sides[1][8] = 0, 0, sides[1][9]
    frames = [spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(side)], "id int, features array<float>") for side in sides]
    monkeypatch.setattr(M, "BLOCK", 16)
    for k, others in ((5, 900), (5, 3)):
        got = {}
        for r in M.best_products(frames[0], frames[1].where(F.col("id") < others), k).collect():
            got.setdefault(r["id"], []).append((r["other"], r["score"]))
        true = sides[0].astype(float) @ sides[1][:others].astype(float).T
        assert got.keys() == set(range(700))
        for i, best in got.items():
            assert len({x for x, _ in best}) == len(best) == min(k, others)
            assert np.allclose(sorted(s for _, s in best), np.sort(true[i])[-k:], rtol=1e-5, atol=1e-6)
            assert all(abs(true[i][x] - s) < 1e-4 for x, s in best)
    assert not M.best_products(frames[0], frames[1].limit(0), 3).collect() and not M.best_products(frames[0].limit(0), frames[1], 3).collect()


def test_saved_factors_recommend_the_same(spark, als):
    path = work_path(spark, "als")
    als.save(path)
    before, after = (sorted((r["id"], r["other"], r["score"]) for r in M.recommend(m, 3, "item").collect()) for m in (als, ALSModel.load(path)))
    assert before == after


@pytest.fixture(scope="module")
def bayes(spark, sf):
    train, test = M.split(L.labelled(spark, sf), "doc_id")
    return M.fit_text(train, 1 << 10), train, test


def matrix(rows):
    return np.array([r["features"].toArray() for r in rows])


def test_weights_are_counts_times_inverse_frequency(bayes):
    model, train, _ = bayes
    rows = M.classify(model, train).select("tf", "features").collect()
    tf = np.array([r["tf"].toArray() for r in rows])
    assert np.allclose(matrix(rows), tf * np.log((len(tf) + 1) / ((tf > 0).sum(axis=0) + 1)))


def test_naive_bayes_by_hand(bayes):
    model, train, test = bayes
    rows = M.classify(model, train).select("label", "features").collect()
    x, y = matrix(rows), np.array([r["label"] for r in rows])
    kinds = np.unique(y)
    sums = np.array([x[y == k].sum(axis=0) for k in kinds])
    theta = np.log((sums + 1) / (sums.sum(axis=1, keepdims=True) + x.shape[1]))
    prior = np.log((np.bincount(y.astype(int))[kinds] + 1) / (len(y) + len(kinds)))
    got = M.classify(model, test).select("label", "features", "prediction").collect()
    odds = matrix(got) @ theta.T + prior
    best = np.sort(odds, axis=1)
    clear = best[:, -1] - best[:, -2] > 1e-6
    assert clear.mean() > 0.9
    assert (kinds[odds.argmax(axis=1)][clear] == np.array([r["prediction"] for r in got])[clear]).all()


def test_saved_classifier_predicts_the_same_and_well(spark, bayes):
    model, _, test = bayes
    path = work_path(spark, "bayes")
    model.save(path)
    before, after = (sorted((r["doc_id"], r["prediction"]) for r in M.classify(m, test).collect()) for m in (model, M.PipelineModel.load(path)))
    assert before == after
    most = test.groupBy("label").count().agg((F.max("count") / F.sum("count")).alias("share")).first()["share"]
    assert M.accuracy(M.classify(model, test)).first()["accuracy"] > max(0.8, most)


def test_word_neighbours_by_cosine(spark, sf):
    model = M.fit_word2vec(table(spark, sf, "documents"))
    vectors = {r["word"]: np.array(r["vector"]) for r in model.getVectors().collect()}
    word = sorted(vectors)[0]
    cosine = {w: v @ vectors[word] / np.linalg.norm(v) / np.linalg.norm(vectors[word]) for w, v in vectors.items() if w != word}
    got = [r["similarity"] for r in M.similar(model, [word], 10).orderBy(F.desc("similarity")).collect()]
    assert np.allclose(got, sorted(cosine.values(), reverse=True)[:10], atol=1e-4)


def test_words_are_learned_by_as_many_tasks_as_texts_are_read_by(spark, tmp_path, monkeypatch):
    """One task for all texts took longer than the limit on 1 GB."""
    spark.createDataFrame([(f"the cat and the dog {i % 3}",) for i in range(120)], "text string").repartition(6).write.parquet(f"{tmp_path}/texts")
    taken, own = [], M.Word2Vec
    monkeypatch.setattr(M, "Word2Vec", lambda **x: taken.append(x["numPartitions"]) or own(**x))
    docs = spark.read.parquet(f"{tmp_path}/texts").repartition(5)
    model = M.fit_word2vec(docs)
    assert taken == [5] and {"the", "cat", "dog"} <= {r["word"] for r in model.getVectors().collect()}


def test_words_are_learned_without_all_of_them_on_the_driver(spark, sf, monkeypatch):
    """The driver held every word with its code and vector, so that it ran out of memory as the words grew."""

    def refused(**x):
        raise AssertionError("learned on the driver")

    rows, own = [], type(spark.range(1)).collect
    monkeypatch.setattr(M, "Word2Vec", refused)
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: rows.append(own(self)) or rows[-1])
    found = L.k13(spark, sf)
    assert all(len(r) <= 1 for r in rows)
    monkeypatch.undo()
    got = found.collect()
    assert len(got) == 10 and {r["of"] for r in got} == {"the"} and all(-1 <= r["similarity"] <= 1 + 1e-6 and r["word"] != "the" for r in got)


def test_word_vectors_tell_words_by_what_stands_beside_them(spark, monkeypatch):
    """Words in like places are alike, in one part and in several; counts are those of all parts; rarer words and empty ones are left out."""
    rng = np.random.default_rng(4)
    animals, metals = ["cat", "dog", "cow"], ["iron", "zinc", "lead"]
    line = lambda own, rest: " ".join(w for _ in range(30) for w in ("the", str(rng.choice(own)), *rng.choice(rest, 2)))
    texts = [(i, line(animals, ["eats", "Sleeps,", "runs"]) if i % 2 else line(metals, ["melts", "rusts.", "shines"])) for i in range(200)]
    texts += [(500 + i, f"  scarce\tx{i}\n") for i in range(5)] + [(600, None), (601, ""), (None, "rare rare rare rare")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    words = {"the", *animals, *metals, "eats", "sleeps", "runs", "melts", "rusts", "shines", "scarce"}
    for most in (1 << 24, 8000):
        monkeypatch.setattr(M, "PART", most)
        vectors = M.word_vectors(docs, "doc_id")
        v = {r["word"]: np.array(r["vector"]) for r in vectors.collect()}
        assert set(v) == words and all(x.shape == (32,) and np.isfinite(x).all() and x.any() for x in v.values())
        got = M.nearest_words(vectors, ["cat", "zinc", "none"], 3).collect()
        assert {r["of"] for r in got} == {"cat", "zinc"} and len(got) == 6
        for w, others in (("cat", animals), ("zinc", metals)):
            cosine = {o: v[o] @ v[w] / np.linalg.norm(v[o]) / np.linalg.norm(v[w]) for o in v if o != w}
            best = sorted(cosine, key=lambda o: (-cosine[o], o))[:3]
            assert set(others) - {w} == set(best[:2])
            assert np.allclose(sorted(r["similarity"] for r in got if r["of"] == w), sorted(cosine[o] for o in best), atol=1e-5)
        again = {r["word"]: np.array(r["vector"]) for r in M.word_vectors(docs.repartition(5), "doc_id").collect()}
        assert all(np.allclose(v[w], again[w], atol=1e-5) for w in v)
    assert not M.word_vectors(docs.limit(0), "doc_id").collect()


def test_words_of_many_and_of_few_rows_are_counted_alike(spark, monkeypatch):
    """With room for few words by lookup, counts are those by hand; a repeated key is one row; words are not dealt out but by the rare ones."""
    texts = [(i % 40, f"the w{i % 7} w{i} the") for i in range(60)] + [(99, None), (98, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    by = {}
    for i, t in texts:
        for w in (t or "").split():
            by[i, w] = by.get((i, w), 0) + 1
    df = {}
    for _, w in by:
        df[w] = df.get(w, 0) + 1
    for most in (1, 10, 200_000):
        monkeypatch.setattr(M, "FREQUENT", most)
        got = M.tf_idf(docs, "doc_id", "text")
        assert sorted(map(tuple, got.select("doc_id", "word", "tf", "df").collect())) == sorted((i, w, n, df[w]) for (i, w), n in by.items())
    assert not M.tf_idf(docs.limit(0), "doc_id", "text").collect()


def test_recommender_job_reports_all_users_and_the_error(spark, sf):
    got = jobs.j9_recommender(spark, sf).collect()
    users = [r for r in got if r["part"] == "user"]
    best = {}
    for r in users:
        best[r["id"]] = max(r["score"], best.get(r["id"], r["score"]))
    model = L.fitted(spark, sf)
    assert len(best) == model.userFactors.count() and len(users) == 10 * len(best)
    again = {r["id"]: r["score"] for r in M.recommend(model, 1).collect()}
    assert all(abs(best[k] - again[k]) < 1e-3 for k in best)
    error = {r["part"]: r["score"] for r in got if r["part"] in ("rmse", "mse")}
    assert error["mse"] > 0 and abs(error["rmse"] ** 2 - error["mse"]) < 1e-9


def test_the_fit_has_blocks_for_its_ratings_and_the_job_joins_them_once(spark, sf, monkeypatch):
    """Ten blocks whatever the ratings ended an executor by memory; the recommender job joined the ratings anew for its error."""
    taken, own, joined = [], M.ALS, []
    monkeypatch.setattr(M, "ALS", lambda **x: taken.append((x.get("numUserBlocks"), x.get("numItemBlocks"))) or own(**x))
    rows = spark.createDataFrame([(u, i, float(u % 3 + i % 2)) for u in range(30) for i in range(10)], "user_id long, item_id long, rating double")
    factors = {r["id"]: r["features"] for r in M.fit_als(rows, 2, 1).userFactors.collect()}
    assert taken == [(10, 10)] and len(factors) == 30
    monkeypatch.setattr(M, "RATINGS", 13)
    assert M.fit_als(rows, 2, 1).userFactors.count() == 30 and taken[1] == (24, 24)
    monkeypatch.setattr(L, "ratings", lambda *x: joined.append(1) or ratings(*x))
    monkeypatch.setattr(jobs, "ratings", lambda *x: joined.append(1) or ratings(*x))
    monkeypatch.setattr(M, "RATINGS", 500)
    got = jobs.j9_recommender(spark, sf)
    n = ratings(spark, sf).count()
    assert joined == [1] and taken[2] == (max(10, -(-n // 500)),) * 2 and got.where("part IN ('rmse', 'mse')").count() == 2


def test_classifier_job_counts_the_held_out_part(spark, sf):
    got = jobs.j9_classifier(spark, sf).collect()
    held = {r["lang"]: r["count"] for r in M.split(L.labelled(spark, sf), "doc_id")[1].groupBy("lang").count().collect()}
    assert {k: sum(r["n"] for r in got if r["lang"] == k) for k in held} == held
    assert sum(r["n"] for r in got if r["lang"] == r["predicted"]) > 0.8 * sum(held.values())
