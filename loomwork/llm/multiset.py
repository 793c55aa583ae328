"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A text is the multiset of its paragraphs (pieces between line feeds that hold a word). Each paragraph hashes to a wide
vector, and a document's fingerprint is the sum of its paragraphs' vectors, lane by lane modulo a power of two:

* identity lanes: four XXH64 hashes of the whole paragraph, each with a seed of its own, as eight lanes modulo 2^32: 256 bits;
* sketch lanes: how often each bit is set in the hashes of the paragraph's word shingles, 64 lanes modulo 2^32, and
  their number.

Sums do not depend on the order of paragraphs, and inserting or deleting a paragraph adds or subtracts its vector, so a
fingerprint can be maintained without the text (`combine`). Equal multisets of paragraphs have equal fingerprints. The
sketch lanes less half the shingles are sums of random signs, so their cosine estimates how many shingles two texts share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import partitions

MOD = 0xFFFFFFFF
PAIR = 0x0000000100000001
#: Seeds of the identity hashes are themselves hashes of these numbers.
SALTS = (1, 2, 3, 4)
IDENTITY = 2 * len(SALTS)
SKETCH = 64
WORDS = 3
SPACE = "[\\x20\\x09-\\x0D]+"
#: Sorted runs of rows for each shuffle partition.
RUNS = 4


def _shingles(text: Column, words: int) -> Column:
    """Hashes of the word shingles of every paragraph; a paragraph of fewer words is one shingle."""
    tokens = F.transform(F.split(text, "\n", -1), lambda p: F.filter(F.split(p, SPACE, -1), lambda w: w != ""))

    def hashes(t: Column) -> Column:
        starts = F.when(F.size(t) > words, F.sequence(F.lit(0), F.size(t) - words)).when(F.size(t) > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(t, i + k) for k in range(words))))

    return F.flatten(F.transform(tokens, hashes))


def _identity(text: Column) -> list[Column]:
    """The identity lanes as sums over paragraphs that hold a word."""
    paragraphs = F.filter(F.split(text, "\n", -1), lambda p: p.rlike("[^\\x20\\x09-\\x0D]"))

    def lane(salt: int, half: int) -> Column:
        def part(p: Column) -> Column:
            h = F.xxhash64(F.lit(salt), p)  # the first argument's hash is the seed of the second's
            return (h if half == 0 else F.shiftrightunsigned(h, 32)).bitwiseAND(F.lit(MOD))

        return F.aggregate(paragraphs, F.lit(0).cast("long"), lambda a, p: (a + part(p)).bitwiseAND(F.lit(MOD)))

    return [lane(salt, half) for salt in SALTS for half in (0, 1)]


def lanes(rows: DataFrame, keys: list[str], kept: list[str], text: str, words: int = WORDS) -> DataFrame:
    """(keys..., kept..., lanes array<long>) of each row: rows must differ in their keys, kept holds numbers. A null text has the lanes of an empty one.

    Shingles are summed by key. Where rows are already dealt by some of the keys this needs no shuffle.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # identity lanes come before the explode, or they would be computed for every shingle
    rows = rows.select(*keys, *kept, *(c.alias(f"_i{k}") for k, c in enumerate(_identity(body))), _shingles(body, words).alias("_hs"))
    rows = rows.select(*keys, *kept, *(f"_i{k}" for k in range(IDENTITY)), F.explode_outer("_hs").alias("_h"))
    h = F.coalesce(F.col("_h"), F.lit(0).cast("long"))
    sums = [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(PAIR))).alias(f"_s{j}") for j in range(32)]
    same = [F.max(c).alias(c) for c in (*kept, *(f"_i{k}" for k in range(IDENTITY)))]
    summed = rows.groupBy(*keys).agg(*same, F.count("_h").alias("_n"), *sums)
    low = [F.col(f"_s{j}").bitwiseAND(F.lit(MOD)) for j in range(32)]
    high = [F.shiftrightunsigned(F.col(f"_s{j}"), 32) for j in range(32)]
    return summed.select(*keys, *kept, F.array(*(F.col(f"_i{k}") for k in range(IDENTITY)), *low, *high, F.col("_n").bitwiseAND(F.lit(MOD))).alias("lanes"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint lanes of the union of two multisets (sign 1), or of the first less the second (sign -1)."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + F.lit(sign) * y, F.lit(MOD + 1)))


def text_of(lanes_column: Column) -> Column:
    """Lanes as text: 8 lowercase hex digits each."""
    return F.array_join(F.transform(lanes_column, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else the cosine of their sketches, from 0 to 1 (0 where a sketch is empty)."""

    def signs(x: Column) -> Column:
        return F.transform(F.slice(x, IDENTITY + 1, SKETCH), lambda v: 2.0 * v - F.element_at(x, -1))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)

    x, y = signs(a), signs(b)
    size = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(a == b, F.lit(1.0)).when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x, y) / size))).otherwise(F.lit(0.0))


def _runs(doc_id: Column, cuts: list[int], lo: int = 0, hi: int | None = None) -> Column:
    """How many of the ascending cuts are not above doc_id, as a decision tree."""
    hi = len(cuts) if hi is None else hi
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(doc_id < F.lit(cuts[mid]), _runs(doc_id, cuts, lo, mid)).otherwise(_runs(doc_id, cuts, mid + 1, hi))


def fingerprint_edits(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Fingerprints of every text, and of the text with its last quarter replaced by the beginning of the next document.

    docs: doc_id, text; other columns are ignored. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. The next document is the one with the next doc_id (equal ones by text),
    after the last the first; a single document is its own next. A row with a null doc_id has no next one: its edited
    text only loses its last quarter, and near_next is 0. Null texts are empty ones. An empty table gives no rows.

    Rows are dealt once, into runs of neighbouring doc_ids. The first row of each run is also sent, as a guest, to the
    run before, so that every row finds its next one in its own run and texts are moved once only.
    """
    count = RUNS * partitions(docs.sparkSession)
    found = docs.agg(F.percentile_approx("doc_id", [i / count for i in range(1, count)], 100 * count).alias("cuts"), F.min("doc_id").alias("least")).first()
    cuts, least = sorted(set(found["cuts"] or [])), found["least"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    nameless = -1 - F.pmod(F.xxhash64("text"), F.lit(count)).cast("int")
    run = F.when(F.col("doc_id").isNull(), nameless).otherwise(_runs(F.col("doc_id"), cuts))
    # each run but the first begins with a cut, which is a doc_id of the table
    before = F.when(F.col("doc_id") == F.lit(least), F.lit(len(cuts))).when(F.col("doc_id").isin(cuts), F.col("run") - 1)
    places = F.filter(F.array(F.struct("run", F.lit(False).alias("guest")), F.struct(before.alias("run"), F.lit(True).alias("guest"))), lambda p: p["run"].isNotNull())
    rows = rows.withColumn("run", run).select("doc_id", "text", F.explode(places).alias("place")).select("place.run", "place.guest", "doc_id", "text")
    order = Window.partitionBy("run").orderBy("guest", "doc_id", "text")
    follower = F.when(F.col("doc_id").isNotNull(), F.lead("text").over(order))
    rows = rows.select("run", F.row_number().over(order).alias("at"), F.col("guest").cast("int").alias("guest"), "doc_id", "text", F.coalesce(follower, F.lit("")).alias("next_text"))
    quarter = "cast(floor(char_length(text) / 4) as int)"
    edited = F.expr(f"concat(left(text, char_length(text) - {quarter}), left(next_text, {quarter}))")
    versions = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), edited.alias("body")))
    rows = rows.select("run", "at", "guest", "doc_id", F.length("text").cast("long").alias("n_chars"), F.explode(versions).alias("v"))
    rows = rows.where("NOT (guest = 1 AND v.which = 1)").select("run", "at", "guest", "doc_id", "n_chars", "v.which", "v.body")
    sha = F.when(F.col("which") == 1, F.sha2(F.col("body").cast("binary"), 256))
    # the digest travels as eight numbers: sums by key keep numbers in place, but texts would be sorted
    parts = [f"sha{i}" for i in range(8)]
    rows = rows.withColumn("sha", sha).withColumns({p: F.conv(F.substring("sha", 8 * i + 1, 8), 16, 10).cast("long") for i, p in enumerate(parts)})
    prints = lanes(rows, ["run", "at", "which"], ["guest", "doc_id", "n_chars", *parts], "body", words)
    order = Window.partitionBy("run").orderBy("at", "which")
    # the original's row is followed by its edited one, and that by the next original
    prints = prints.select("*", F.lead("lanes", 1).over(order).alias("other"), F.lead("lanes", 2).over(order).alias("next"), *(F.lead(p, 1).over(order).alias(f"next_{p}") for p in parts))
    out = prints.where("which = 0 AND guest = 0")
    follows = F.when(F.col("doc_id").isNotNull(), likeness(F.col("lanes"), F.col("next"))).otherwise(F.lit(0.0))
    digest = F.concat(*(F.lower(F.lpad(F.hex(f"next_{p}"), 8, "0")) for p in parts))
    return out.select("doc_id", "n_chars", digest.alias("edited_sha256"), text_of(F.col("lanes")).alias("fingerprint"), text_of(F.col("other")).alias("edited_fingerprint"), likeness(F.col("lanes"), F.col("other")).alias("near_edited"), follows.alias("near_next"))
