"""The thin queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import audit, langid, mih, mixing, multiset, ngram_lm, quotes, rollup, secrets, shallot, simhash, spm, subwords
from loomwork.llm.common import read_table, shared_path


def op1_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other vectors of every hundredth."""
    return mih.neighbours(read_table(spark, sf_dir, "embeddings"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page, with trigrams from all documents."""
    return langid.identify_pages(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.components(read_table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and checks of every document."""
    return spm.summary(read_table(spark, sf_dir, "documents"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of those that are not held out."""
    return ngram_lm.train_and_score(read_table(spark, sf_dir, "documents"))


def op6_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return multiset.fingerprint_edits(read_table(spark, sf_dir, "documents"))


def op7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as threads of quoting replies, linked and put in reply order; the table itself holds no quoted line."""
    return quotes.chat(quotes.quoted_replies(read_table(spark, sf_dir, "conversations")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op9_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after inserts, revisions and deletions of all documents."""
    return rollup.maintain(read_table(spark, sf_dir, "documents"), rollup.VOCABULARY, "byte_bpe_50k", shared_path(spark, "rollup"))


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling weights of the labelled documents: good ones weigh four times as much as poor ones, the rest 1."""
    return read_table(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("weight"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    return mixing.mix(read_table(spark, sf_dir, "documents"), quality_weights(spark, sf_dir)).drop("epochs")


def op11_shallot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector after three rounds."""
    return shallot.cluster(read_table(spark, sf_dir, "embeddings")).drop("looked")


def op12_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    return subwords.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes in each order, by language."""
    return audit.audit(spark, f"{sf_dir}/documents.parquet", read_table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_mih, op2_langid, op3_simhash, op4_sentencepiece, op5_lm, op6_multiset, op7_quotes, op8_secrets, op9_rollup, op10_mixing, op11_shallot, op12_subwords, op13_audit)
    return {f.__name__: f for f in found}


#: The whole mix: digests and keys as mixing states them, targets by the level of the first source that is not full.
MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5(CAST('{mixing.SEED}' AS BLOB) || '\\x00'::BLOB || CAST(coalesce(CAST(doc_id AS VARCHAR), '') AS BLOB) || '\\x00'::BLOB || encode(coalesce(text, ''))) AS digest
  FROM documents),
q AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 2.0 ELSE 0.5 END) AS weight FROM labels WHERE quality IS NOT NULL GROUP BY 1),
k AS (
  SELECT d.*, -ln((CAST('0x' || substr(digest, 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / coalesce(weight, 1.0) AS key
  FROM d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM k GROUP BY source),
w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w, CAST(2.0 * source_size AS DOUBLE) AS cap,
    CAST(1.5 * sum(source_size) OVER () AS DOUBLE) AS budget FROM s),
f AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM w),
l AS (SELECT *, (budget - filled) / open_w AS level FROM f),
t AS (
  SELECT source, source_size, CAST(CASE WHEN cap <= level * w THEN cap ELSE (SELECT min_by(level, filled) FROM l WHERE cap > level * w) * w END AS DOUBLE) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (
  SELECT k.*, p.source_size, p.target, p.epochs, greatest(0, CAST(round(p.target) AS BIGINT) - p.epochs * p.source_size) AS rest,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM r"""


def clusters_sql(k: int = 16, rounds: int = 3, size: int = 64, salt: int = 1) -> str:
    """The rounds one after the other, each centroid compared with each vector; floors of quotients by remainders that are not negative."""
    ints = "list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))"
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {ints} AS e FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY mark NULLS LAST, e) - 1 AS INT) AS j, e AS c FROM (SELECT sha256('{salt}:' || CAST(vec_id AS VARCHAR)) AS mark, e FROM v) ORDER BY mark NULLS LAST, e LIMIT {k})",
    ]
    square = "CAST(list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := {square}, j := j)) AS m FROM v CROSS JOIN c{i} GROUP BY r)")
        if i < rounds:
            floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            parts = f"SELECT j, i, sum(x) AS s, CAST(count(*) AS HUGEINT) AS n FROM (SELECT m.j AS j, unnest(e) AS x, unnest(range({size})) AS i FROM a{i} JOIN v USING (r)) GROUP BY ALL"
            steps.append(f"n{i} AS MATERIALIZED (SELECT j, list({floor} ORDER BY i) AS c FROM ({parts}) GROUP BY j)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT o.j, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN n{i} n USING (j))")
    last = f"a{rounds}"
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, m.j AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.j) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(c, ',')) AS centroid_sha256 FROM {last} JOIN v USING (r) JOIN c{rounds} ON c{rounds}.j = m.j"
    )


#: Masks of the five filters, then all orders of the letters.
AUDIT_SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
m AS (
  SELECT doc_id, part, CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT)
    + 4 * CAST(100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask FROM d),
f AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m LEFT JOIN f USING (doc_id) GROUP BY ALL),
l(k, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT concat(v.k, w.k, x.k, y.k, z.k) AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits FROM l v, l w, l x, l y, l z WHERE v.b + w.b + x.b + y.b + z.b = 31 AND len(list_distinct([v.b, w.b, x.b, y.b, z.b])) = 5),
s AS (SELECT filter_order, CAST(i AS INT) AS step, bits[i] AS bit, CAST(coalesce(list_sum(bits[1:i - 1]), 0) AS INT) AS earlier FROM o, range(1, 6) r(i)),
g AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & bit > 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & earlier > 0 AND mask & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & earlier = 0 AND mask & bit > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & earlier = 0 AND mask & bit > 0), 0) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM g"""


def oracle_sql() -> dict[str, str]:
    """Those within SQL; the others hash, learn or tokenise, and are tested against brute force."""
    return {"op10_mixing": MIX_SQL, "op11_shallot": clusters_sql(), "op13_audit": AUDIT_SQL}
