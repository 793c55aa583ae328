"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target of words. Whole epochs of a source come first: each of its documents once per epoch. What is
left of the target is drawn without replacement: a document's key is exponential, -ln(u) / weight with u from a hash of
the document, so that the smallest keys are a sample in which heavier documents come earlier; documents are taken in the
order of their keys until their prefix sum of words reaches the rest of the target, and the last one in part.

No source is sorted to find where its sample ends. Words are summed by the keys' logarithms in steps of 1/256, some
thousands of steps a source whatever the weights, then, in the step of the end alone, by steps of 2^-20 of that; what is
left in one of those is a few documents and is sorted. Each source so gets its edge: the document at which its sample ends
and what is left for it there. A document's words follow from its own key and its source's edge, so no table of texts is
joined by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import by_source, fresh, materialize

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Steps of a key's binary logarithm that words are summed by first, and steps of one of those.
COARSE, FINE = 256, 1 << 20
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs) -> the same with target double.

    Sources by code point, null last, take `weights` in turn and share `share` of all words by weight; no target is above
    `most` times its source, and what is beyond is shared again among the others. A source that is full at the level of
    one full source is full at all higher levels, so the sources in the order of (cap / weight) give the level in one
    pass. One row for each source: this table is as long as the mix has sources.
    """
    everything = Window.partitionBy()
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(place, F.lit(len(weights))) + 1)
    rows = sizes.select("*", weight.alias("w"))
    rows = rows.select("*", (F.lit(float(most)) * F.col("source_size")).alias("cap"), (F.lit(float(share)) * F.sum("source_size").over(everything)).alias("budget"))
    fill = Window.partitionBy().orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    rows = rows.select("*", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("full"), F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)).alias("open_w"))
    # the level at which this source would stop, were all before it full and none after
    rows = rows.withColumn("level", (F.col("budget") - F.col("full")) / F.col("open_w"))
    rows = rows.withColumn("is_full", F.col("cap") <= F.col("level") * F.col("w"))
    level = F.min(F.when(~F.col("is_full"), F.struct("full", "open_w", "level"))).over(everything)["level"]
    return rows.select("source", "source_size", "n_docs", F.when(F.col("is_full"), F.col("cap")).otherwise(level * F.col("w")).alias("target"))


def quality_of(text: Column) -> Column:
    """A weight from the text alone: between 0.5 and 2, larger for a larger share of letters among what is not white space."""
    body = F.coalesce(text, F.lit(""))
    share = F.length(F.regexp_replace(body, r"[^\p{L}]+", "")) / F.greatest(F.lit(1), F.length(F.regexp_replace(body, r"\s+", "")))
    return 0.5 + 1.5 * share


def _keyed(docs: DataFrame, quality: DataFrame | Column | None, seed: str, more: dict[str, Column]) -> tuple[DataFrame, dict[str, str]]:
    """docs with `more`, a digest and the sampling key under names that docs does not have, and these names."""
    names = {n: fresh(docs, n) for n in ("digest", "key", "weight", "q_id", *more)}
    text, doc_id = F.col("text"), F.col("doc_id")
    digest = F.md5(F.concat_ws("\x00", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary"))
    rows = docs.withColumns({names["digest"]: digest, **{names[n]: c for n, c in more.items()}})
    if isinstance(quality, DataFrame):
        quality = quality.groupBy(F.col("doc_id").alias(names["q_id"])).agg(F.max("weight").cast("double").alias(names["weight"]))
        rows = rows.join(quality, rows["doc_id"] == quality[names["q_id"]], "left")
    else:
        rows = rows.withColumn(names["weight"], F.lit(None).cast("double") if quality is None else quality)
    # 52 bits, off both ends of the unit interval
    u = (F.conv(F.substring(names["digest"], 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    weight = F.when(F.col(names["weight"]) > 0, F.col(names["weight"])).otherwise(F.lit(1.0))
    return rows.withColumn(names["key"], -F.log(u) / weight), names


def _edges(rows: DataFrame) -> DataFrame:
    """rows (doc_id, source, size, digest, key) -> one row a source: p_source, source_size, target, epochs, rest, edge, share, half.

    edge is the (key, doc_id, digest) at which the sample of `rest` words ends, null for an empty one; share the words that
    each row of that edge gives (rows that are equal share evenly), half whether that is half of its size or more.
    """
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")))
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.greatest(F.lit(0), F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")))
    plan = materialize(plan.withColumnRenamed("source", "p_source"), "mix_plan")

    def ends(sums: DataFrame, by: str) -> DataFrame:
        """Of (p_source, by, words, rest) the rows at which the words of a source reach its rest, with the words before them."""
        order = Window.partitionBy("p_source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        placed = sums.select("*", F.coalesce(F.sum("words").over(order), F.lit(0)).alias("before"))
        return placed.where("before < rest AND before + words >= rest")

    wanted = plan.where("rest > 0").select("p_source", "rest")
    log = F.log2("key") * COARSE
    steps = rows.where("size > 0").select("source", "doc_id", "digest", "key", "size", F.floor(log).alias("step"), F.floor((log - F.floor(log)) * FINE).alias("fine"))
    sums = steps.groupBy(F.col("source").alias("name"), "step").agg(F.sum("size").alias("words"))
    at = ends(wanted.join(sums, F.col("p_source").eqNullSafe(F.col("name"))).select("p_source", "rest", "step", "words"), "step")
    at = materialize(at.select("p_source", F.col("step").alias("at_step"), (F.col("rest") - F.col("before")).alias("rest")), "mix_steps")
    inside = by_source(steps, at, "source", "p_source").where("step = at_step").withColumnRenamed("source", "p_source")
    sums = inside.groupBy("p_source", "rest", "fine").agg(F.sum("size").alias("words"))
    near = ends(sums, "fine").select(F.col("p_source").alias("f_source"), F.col("fine").alias("at_fine"), (F.col("rest") - F.col("before")).alias("left"))
    near = materialize(near, "mix_fine")
    inside = by_source(inside, near, "p_source", "f_source").where("fine = at_fine")
    inside = inside.groupBy("p_source", F.struct("key", "doc_id", "digest").alias("edge"), "left").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"), F.max("size").alias("size"))
    edge = ends(inside.withColumnRenamed("left", "rest"), "edge")
    share = F.floor((F.col("rest") - F.col("before")) / F.col("rows"))
    edge = edge.select(F.col("p_source").alias("e_source"), "edge", share.alias("share"), (2 * share >= F.col("size")).alias("half"))
    out = plan.join(edge, F.col("p_source").eqNullSafe(F.col("e_source")), "left")
    return materialize(out.select("p_source", "source_size", "target", "epochs", "rest", "edge", "share", "half"), "mix_edges")


def _slim(docs: DataFrame, quality: DataFrame | Column | None, seed: str) -> DataFrame:
    slim = docs.select("doc_id", "text", "source")
    rows, names = _keyed(slim, quality, seed, {"size": words(F.col("text"))})
    return materialize(rows.select("doc_id", "source", *(F.col(names[n]).alias(n) for n in ("size", "digest", "key"))), "mix_rows")


def mix(docs: DataFrame, quality: DataFrame | Column | None = None, seed: str = SEED) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, size, source_size, target, taken, epochs.

    taken is the number of words that the mix takes of the document, repeats counted: `epochs` whole passes, and in the
    last one maybe a part. quality: optional (doc_id, weight), or a weight as a column of doc_id, text and source; other
    documents, null weights and weights of 0 or less count as 1. The result depends on the rows only: u comes from the
    MD5 of seed, doc_id and text, and equal keys are ordered by doc_id and the MD5; rows equal in all of these, where the
    sample ends, share evenly what is left, less than one word each falling away. Null texts have size 0 and take
    nothing. Null doc_ids are documents like others. An empty table gives none; other columns are ignored.
    """
    rows = _slim(docs, quality, seed)
    cut = by_source(rows, _edges(rows), "source", "p_source")
    place = F.struct("key", "doc_id", "digest")
    part = F.when(place < F.col("edge"), F.col("size")).when(place == F.col("edge"), F.least("size", "share")).otherwise(F.lit(0))
    part = F.when(F.col("edge").isNotNull(), part).otherwise(F.lit(0))
    return cut.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "epochs")


def repeated(docs: DataFrame, quality: DataFrame | Column | None = None, seed: str = SEED) -> DataFrame:
    """docs as the mix takes them: a row for each whole pass, and one more where at least half of the last pass is taken; the columns stay as they are.

    Documents without words are taken never; null doc_ids are documents like others; an empty table gives none. With a
    quality column no text is shuffled: each row finds its passes from its own key and its source's edge. A quality
    table is joined by doc_id, and so moves the texts.
    """
    edges = _edges(_slim(docs, quality, seed))
    plan = edges.select(F.struct(*edges.columns).alias("plan"), "p_source")
    rows, names = _keyed(docs, quality, seed, {"times": F.lit(0)})
    held = fresh(rows, "plan")
    found = by_source(rows, plan.select(F.col("plan").alias(held), "p_source"), "source", "p_source")
    place = F.struct(F.col(names["key"]).alias("key"), F.col("doc_id").alias("doc_id"), F.col(names["digest"]).alias("digest"))
    edge = F.col(held)["edge"]
    last = F.when(edge.isNull(), F.lit(0)).when(place < edge, F.lit(1)).when((place == edge) & F.col(held)["half"], F.lit(1)).otherwise(F.lit(0))
    times = F.when(F.coalesce(F.col("text"), F.lit("")).rlike(WORD), F.col(held)["epochs"].cast("int") + last).otherwise(F.lit(0))
    passes = F.explode(F.sequence(F.lit(1), F.col(names["times"])))
    found = found.withColumn(names["times"], times).where(F.col(names["times"]) > 0)
    return found.select(*(F.col(f"`{c}`") for c in docs.columns), passes.alias(names["key"])).select(*(F.col(f"`{c}`") for c in docs.columns))
