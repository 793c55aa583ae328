"""Recommendation and text classification on tables, with pyspark.ml."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, Word2Vec, Word2VecModel
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.columns import normalize_words
from loomwork.operators import sinks as S
from loomwork.session import work_path


#: Ratings of a block of the fit, about: a task holds one, at some 50 bytes a rating while it is made.
RATINGS = 8_000_000


def fit_als(ratings: DataFrame, rank: int = 10, iterations: int = 10, seed: int = 1, known: int | None = None) -> ALSModel:
    """ratings: user_id, item_id, rating. Users and items must fit 32-bit integers. known: how many ratings there are at most, counted if not given.

    The fit's blocks, ten at least, grow in number with the ratings and not in size. Factors depend on their number.
    """
    rows = ratings.select(F.col("user_id").cast("int"), F.col("item_id").cast("int"), F.col("rating").cast("float"))
    blocks = max(10, -(-(rows.count() if known is None else known) // RATINGS))
    return ALS(userCol="user_id", itemCol="item_id", ratingCol="rating", rank=rank, maxIter=iterations, seed=seed, coldStartStrategy="drop", numUserBlocks=blocks, numItemBlocks=blocks).fit(rows)


def score(model: ALSModel, rows: DataFrame) -> DataFrame:
    """rows (user_id, item_id) with the model's `prediction`, as model.transform() gives it where unknown users and items are dropped; null ones are dropped too.

    Factors are looked up in tables of each task's share of them, so that rows are not sorted, and rows that lie by user already
    move once only, by item.
    """
    own, others = (f.select(F.col("id").alias(f"{side}_id"), F.col("features").alias(side)).hint("shuffle_hash") for f, side in ((model.userFactors, "user"), (model.itemFactors, "item")))
    product = reduce(add, (F.get("user", F.lit(i)) * F.get("item", F.lit(i)) for i in range(model.rank)))
    return rows.join(own, "user_id").join(others, "item_id").select(*rows.columns, product.alias("prediction")).where(~F.isnan("prediction"))


#: Rows of a block of factors; blocks of the longest factors that give each row its first k.
BLOCK, FIRST = 2048, 4
#: Scores are products in 32 bits; what a bound may be off by.
SLACK = 1e-4


def recommend(model: ALSModel, k: int = 10, side: str = "user", subset: DataFrame | None = None) -> DataFrame:
    """The k best items of each user (side user) or users of each item, for all or for a subset, as rows: id, other, score."""
    own, others = (model.userFactors, model.itemFactors) if side == "user" else (model.itemFactors, model.userFactors)
    if subset is not None:
        own = own.join(subset.select(F.col(f"{side}_id").cast("int").alias("id")).distinct(), "id", "left_semi")
    return best_products(own, others, k)


def _length(col: str) -> Column:
    return F.sqrt(F.aggregate(col, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _packed(size: int):
    """Rows (id, features, far, and what was found for each) as blocks: the columns end to end, the greatest and least `far` of the block."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), size):
                x = rows.iloc[at : at + size]
                found = [np.concatenate(x[c].to_list()).astype(t).tobytes() if c in x else b"" for c, t in (("other", np.int32), ("score", np.float32))]
                yield pd.DataFrame({"ids": [x["id"].to_numpy(np.int32).tobytes()], "vectors": [np.concatenate(x["features"].to_list()).astype(np.float32).tobytes()], "others": [found[0]], "scores": [found[1]], "most": [x["far"].max()], "least": [x["far"].min()]})

    return pack


def _blocks(rows: DataFrame, path: str) -> DataFrame:
    """rows as blocks of those whose `far` is alike, greatest first in a block's rows; written, so that a block keeps its rows and number."""
    near = rows.repartitionByRange(F.desc("far")).sortWithinPartitions(F.desc("far"))
    packed = near.mapInPandas(_packed(BLOCK), "ids binary, vectors binary, others binary, scores binary, most double, least double")
    packed.withColumn("block", F.monotonically_increasing_id()).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _search(k: int, first: Sequence[int], begun: bool):
    """Pairs of blocks (q_*, o_*): the k best of each row of q, over all that a task sees of o. Once begun, the first blocks are in q's rows."""

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = None

        def result() -> pd.DataFrame:
            if begun:
                where, rank = np.nonzero((others >= 0) & (fresh | whole))
                return pd.DataFrame({"id": ids[where], "other": others[where, rank], "score": scores[where, rank]})
            least = scores[:, -1].astype(float)
            far = np.where(lengths > 0, least * (1 - np.sign(least) * SLACK) / np.maximum(lengths, 1e-30), -np.inf)
            return pd.DataFrame({"id": ids, "features": list(vectors), "other": list(others), "score": list(scores), "far": far})

        for pairs in batches:
            for p in pairs.itertuples(index=False):
                if p.q_block != block:
                    if block is not None:
                        yield result()
                    block, whole, ids = p.q_block, False, np.frombuffer(p.q_ids, np.int32)
                    vectors = np.frombuffer(p.q_vectors, np.float32).reshape(len(ids), -1)
                    lengths = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
                    others, scores = np.full((len(ids), k), -1, np.int32), np.full((len(ids), k), -np.inf, np.float32)
                    if begun:
                        others, scores = (np.frombuffer(x, t).reshape(len(ids), k).copy() for x, t in ((p.q_others, np.int32), (p.q_scores, np.float32)))
                    fresh = np.zeros(others.shape, bool)
                if begun and p.o_block in first:
                    whole = True  # of all tasks only this one gives what the first blocks gave
                    continue
                # what no row of the other block can pass is not multiplied
                rows = np.flatnonzero(lengths * p.o_most * (1 + SLACK) > scores[:, -1])
                known = np.frombuffer(p.o_ids, np.int32)
                theirs = np.frombuffer(p.o_vectors, np.float32).reshape(len(known), -1)
                product = vectors[rows] @ theirs.T
                better = product.max(axis=1) + SLACK * 0.01 * lengths[rows] * p.o_most > scores[rows, -1]
                rows, product = rows[better], product[better]
                if not len(rows):
                    continue
                n = min(k, len(known))
                top = np.argpartition(-product, n - 1, axis=1)[:, :n]
                # a score is the same in whatever blocks its rows lie
                at = (vectors[rows].astype(float)[:, None, :] * theirs[top].astype(float)).sum(axis=2).astype(np.float32)
                new, at = np.hstack([others[rows], known[top]]), np.hstack([scores[rows], at])
                order = np.lexsort((new, -at), axis=-1)[:, :k]
                others[rows], scores[rows] = np.take_along_axis(new, order, axis=1), np.take_along_axis(at, order, axis=1)
                fresh[rows] = np.take_along_axis(np.hstack([fresh[rows], np.ones(top.shape, bool)]), order, axis=1)
        if block is not None:
            yield result()

    return steps


def best_products(own: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """For each row of own (id, features) the k rows of others with the greatest product: id, other, score. No pair is left out unseen.

    Both lie in blocks; the blocks of the longest others give each row its first k. A product is at most that of the lengths, so a
    row then only meets blocks whose longest can pass its k-th, and rows that reach alike share blocks. A task holds two blocks and
    their products. Of rows whose products are equal in 32 bits to the k-th any may be given.
    """
    spark = own.sparkSession
    path, tasks = work_path(spark, "products"), spark.sparkContext.defaultParallelism
    right = _blocks(others.select("id", "features", _length("features").alias("far")), f"{path}/others")
    left = _blocks(own.select("id", "features", _length("features").alias("far")), f"{path}/own")
    first = [r["block"] for r in right.orderBy(F.desc("most"), "block").limit(FIRST).select("block").collect()]
    q = lambda df: df.select(*(F.col(c).alias(f"q_{c}") for c in ("block", "ids", "vectors", "others", "scores", "least"))).repartition(2 * tasks, "q_block")
    o = right.select(*(F.col(c).alias(f"o_{c}") for c in ("block", "ids", "vectors", "most")))
    started = q(left).crossJoin(F.broadcast(o.where(F.col("o_block").isin(first)))).mapInPandas(_search(k, first, False), "id int, features array<float>, other array<int>, score array<float>, far double")
    reach = (F.col("o_most") >= F.col("q_least")) & ~F.col("o_block").isin(first) | F.col("o_block").isin(first[:1])
    pairs = q(_blocks(started, f"{path}/begun")).join(o.repartition(4, "o_block").sortWithinPartitions(F.desc("o_most")).hint("shuffle_replicate_nl"), reach)
    found = pairs.mapInPandas(_search(k, first, True), "id int, other int, score float")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other")))
    return ranked.where(F.col("r") <= k).drop("r")


def rmse_mse(scored: DataFrame, prediction: str = "prediction", rating: str = "rating") -> DataFrame:
    mse = F.avg(F.pow(F.col(prediction) - F.col(rating), 2))
    return scored.agg(F.sqrt(mse).alias("rmse"), mse.alias("mse"))


def split(df: DataFrame, key: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Two parts by a hash of the key: the same at every run, whatever the partitions."""
    place = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 1000
    return df.where(place < int(share * 1000)), df.where(place >= int(share * 1000))


def text_pipeline(dims: int = 100_000, classify: bool = True) -> Pipeline:
    stages = [RegexTokenizer(inputCol="words", outputCol="tokens", pattern="\\s+"), HashingTF(inputCol="tokens", outputCol="tf", numFeatures=dims), IDF(inputCol="tf", outputCol="features")]
    return Pipeline(stages=[*stages, NaiveBayes(featuresCol="features", labelCol="label")] if classify else stages)


def fit_text(docs: DataFrame, dims: int = 100_000, classify: bool = True) -> PipelineModel:
    """docs: text, and label to classify."""
    return text_pipeline(dims, classify).fit(docs.withColumn("words", normalize_words(F.col("text"))))


def classify(model: PipelineModel, docs: DataFrame) -> DataFrame:
    return model.transform(docs.withColumn("words", normalize_words(F.col("text"))))


def accuracy(df: DataFrame) -> DataFrame:
    return df.agg((F.count_if(F.col("label") == F.col("prediction")) / F.count(F.lit(1))).alias("accuracy"))


def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


#: Words of a table of counts that is sent to all tasks, at most.
FREQUENT = 200_000


def tf_idf(docs: DataFrame, key: str, col: str) -> DataFrame:
    """key, word, tf, df: how often a word stands in a row, and in how many rows.

    Texts are dealt out by key, not their words. Words in so many rows that there can be only FREQUENT of them are looked up in a
    table that each task has; only the rows of the others are dealt out by word.
    """
    spark = docs.sparkSession
    words = docs.select(key, col).repartition(key).select(key, F.explode(F.split(F.trim(normalize_words(F.col(col))), r"\s+")).alias("word")).where("word <> ''")
    tf = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("tf"))
    path = work_path(spark, "words")
    tf.groupBy("word").agg(F.count(F.lit(1)).alias("df")).write.parquet(path)
    df = spark.read.parquet(path)
    least = -(-(df.agg(F.sum("df")).first()[0] or 0) // FREQUENT)
    looked = tf.join(F.broadcast(df.where(F.col("df") >= least)), "word", "left").select("word", key, "tf", "df")
    rare = looked.where("df IS NULL").drop("df").join(df.where(F.col("df") < least), "word")
    return looked.where("df IS NOT NULL").union(rare)


def fit_word2vec(docs: DataFrame, size: int = 32, least: int = 5, seed: int = 1) -> Word2VecModel:
    """Vectors of words; each part of the texts as they are read is learned from in a task of its own, and the parts' vectors are put together.

    The driver holds all words, their codes and vectors; word_vectors() learns from any number of words.
    """
    rows = docs.select(F.split(F.trim(normalize_words(F.col("text"))), r"\s+").alias("tokens"))
    return Word2Vec(inputCol="tokens", outputCol="vector", vectorSize=size, minCount=least, maxIter=1, seed=seed, numPartitions=max(1, docs.rdd.getNumPartitions())).fit(rows)


def similar(model: Word2VecModel, words: Sequence[str], k: int = 10) -> DataFrame:
    found = [model.findSynonyms(w, k).select(F.lit(w).alias("of"), "word", "similarity") for w in words]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


#: Characters of the texts that one task learns from at once, about.
PART = 8 << 20
#: Words on each side that a centre meets at most; words of a text that one window passes over; draws against each pair.
WINDOW, SENTENCE, AGAINST = 5, 1000, 5
#: Centres of a step, and words drawn for all of its pairs; the rate of learning; the greatest starting component of a word and of a context.
CENTRES, DRAWN, RATE, START = 2048, 64, 0.1, (1 / 64, 0.25)


def _starts(words: np.ndarray, size: int, salt: int) -> np.ndarray:
    """Components between -1 and 1 from the words' hashes alone, so that all parts begin alike."""
    found = np.empty((len(words), size), np.float32)
    for i in range(size):
        x = (words.view(np.uint64) + np.array((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)) ^ np.array(salt * 0xD6E8FEB86659FD93 % (1 << 64), np.uint64)
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
        found[:, i] = ((x ^ (x >> np.uint64(31))) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 23) - 1
    return found


def _towards(vectors: np.ndarray, squares: np.ndarray, rows: np.ndarray, change: np.ndarray) -> None:
    """One step of some rows, repeats added up, the shorter the more a row has moved (Adagrad, a rate for each row)."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    at = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    g, rows = np.add.reduceat(change[order], at, axis=0), rows[at]
    squares[rows] += (g * g).mean(axis=1)
    vectors[rows] += RATE * g / np.sqrt(squares[rows])[:, None]


def _skip_grams(words: np.ndarray, sentence: np.ndarray, hashes: np.ndarray, counts: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Vectors of the words of a part: skip-grams against drawn words. words: indices into hashes, in order of the texts."""
    rng, n = np.random.default_rng(seed), len(words)
    own, context = (most * _starts(hashes, size, 2 * seed + i) for i, most in enumerate(START))
    squares = np.full((2, len(hashes)), 1e-8, np.float32)
    shares = np.cumsum(counts.astype(float) ** 0.75)
    for a in range(0, n, CENTRES):
        at = np.arange(a, min(a + CENTRES, n))
        reach = rng.integers(1, WINDOW + 1, len(at))
        pairs = [(c, o) for d in range(1, WINDOW + 1) for c in [at[reach >= d]] for o in (c - d, c + d)]
        centre, other = (np.concatenate(x) for x in zip(*pairs))
        inside = (other >= 0) & (other < n)
        inside &= sentence[np.where(inside, other, 0)] == sentence[centre]
        if not inside.any():
            continue
        centre, other = words[centre[inside]], words[other[inside]]
        drawn = np.minimum(np.searchsorted(shares, rng.random(DRAWN) * shares[-1], side="right"), len(counts) - 1)
        v, u, w = own[other], context[centre], context[drawn]
        near = 1 / (1 + np.exp(np.clip((v * u).sum(axis=1), -30, 30)))[:, None]
        far = np.float32(-AGAINST / DRAWN) / (1 + np.exp(np.clip(-(v @ w.T), -30, 30)))
        _towards(own, squares[0], other, near * u + far @ w)
        _towards(context, squares[1], np.concatenate([centre, drawn]), np.concatenate([near * v, far.T @ v]))
    return own


def _learn(size: int, seed: int):
    """The texts of a part (tokens: hashes of words) and its words (h, n) to vectors of these."""

    def run(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        if not len(texts) or not len(words):
            return pd.DataFrame({"h": [], "vector": []})
        words = words.drop_duplicates("h").sort_values("h")
        texts = texts.sort_values("key")
        hashes, known, sentences, begun = words["h"].to_numpy(np.int64), [], [], 0
        for tokens in texts["tokens"]:
            at = np.minimum(np.searchsorted(hashes, tokens), len(hashes) - 1)
            known.append(at[hashes[at] == tokens].astype(np.int32))
            sentences.append((begun + np.arange(len(known[-1])) // SENTENCE).astype(np.int32))
            begun += len(known[-1]) // SENTENCE + 1
        vectors = _skip_grams(np.concatenate(known), np.concatenate(sentences), hashes, words["n"].to_numpy(), size, seed)
        return pd.DataFrame({"h": hashes, "vector": list(vectors)})

    return run


def word_vectors(docs: DataFrame, key: str, size: int = 32, least: int = 5, seed: int = 1) -> DataFrame:
    """word, vector: of each word that stands in the texts `least` times; skip-grams learned in parts, whose vectors are averaged.

    docs: key, text. Texts are dealt out by key into parts of about PART characters, one task holds one part and its words, and the
    averages are taken by word, so that no task and not the driver holds all words. Each part begins from vectors made of the words'
    hashes. Words are told apart in a part by hashes of 64 bits. The result depends on the number of parts, not on how files lie.
    """
    spark = docs.sparkSession
    path, lying = work_path(spark, "words"), f"texts_{uuid.uuid4().hex}"
    parts = -(-(docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 1) // PART)
    dealt = docs.where("text IS NOT NULL").select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), F.struct(F.col(key), F.xxhash64("text")).alias("key"), "text")
    S.save_bucketed(dealt, lying, "part", max(parts, S.BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    tokens = F.filter(F.split(normalize_words(F.col("text")), r"\s+"), lambda w: w != "")
    texts = spark.table(lying).select("part", F.xxhash64("key").alias("key"), tokens.alias("tokens"))
    texts.select("part", F.explode("tokens").alias("word")).groupBy("part", "word").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("word", F.xxhash64("word").alias("h"), "n").write.parquet(f"{path}/known")
    known = spark.read.parquet(f"{path}/known")
    own = counts.select("part", "word").join(known.hint("merge"), "word").select("part", "h", "n")
    hashed = texts.select("part", "key", F.transform("tokens", lambda w: F.xxhash64(w)).alias("tokens"))
    learned = hashed.groupBy("part").cogroup(own.groupBy("part")).applyInPandas(_learn(size, seed), "h long, vector array<float>")
    mean = learned.groupBy("h").agg(*(F.avg(F.col("vector")[i]).alias(f"v{i}") for i in range(size)))
    mean.join(known.hint("merge"), "h").select("word", F.array(*(F.col(f"v{i}").cast("float") for i in range(size))).alias("vector")).write.parquet(f"{path}/vectors")
    spark.sql(f"DROP TABLE `{lying}`")
    return spark.read.parquet(f"{path}/vectors")


def nearest_words(vectors: DataFrame, words: Sequence[str], k: int = 10) -> DataFrame:
    """The k other words with the greatest cosine to each of some words: of, word, similarity. A word without a vector has no row."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    given = vectors.where(F.col("word").isin(list(words))).select(F.col("word").alias("of"), F.col("vector").alias("to"))
    cosine = F.try_divide(dot("to", "vector"), F.sqrt(dot("to", "to") * dot("vector", "vector")))
    pairs = vectors.join(F.broadcast(given), F.col("of") != F.col("word")).select("of", "word", cosine.alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("similarity"), "word"))
    return pairs.withColumn("r", rank).where(F.col("r") <= k).drop("r")
