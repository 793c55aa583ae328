"""Language identification by fusing evidence with Bayes' rule.

The evidence for each language is
* the text: log-likelihood of its byte trigrams, from counts over all labelled documents, tempered so that a long text
  does not drown the rest;
* the declared language of the markup: how often pages of a language declare what, by counts;
* the address suffix and the host: a prior that is smoothed from the host to its domain, its suffix and all pages, each
  level's expected counts (summed by grouped aggregation) on top of the level above.

One more class, `und`, spreads its trigrams evenly over all buckets: what no language explains better goes there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from loomwork.llm.common import by_source, give_back, materialize, text_batches, text_pieces

BUCKETS = 1 << 16
UNKNOWN = "und"
#: Trigrams that a text's likelihood counts for at most, and the pseudo-counts of a level on the one below.
MOST, STRENGTH = 100.0, 5.0
#: Expected share of `und`, and of declarations that say nothing about the text.
UNKNOWN_SHARE, NOISE = 0.001, 0.05
#: Languages of country suffixes, as pseudo-counts of the suffix level.
COUNTRIES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "ie": "en", "au": "en"}
COUNTRY_STRENGTH = 20.0

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


def _trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every trigram of bytes within a word and its borders: A-Z folded, all ASCII that is no letter a space."""
    raw = [(" " + (t or "") + " ").encode("utf-8", "replace") for t in texts]
    flat = _FOLD[np.frombuffer(b"  ".join(raw) + b"  ", np.uint8)]
    a, b, c = (flat[i : len(flat) - 2 + i] for i in range(3))
    inside = np.flatnonzero((b != 32) & ((a != 32) | (c != 32)))
    code = (a[inside].astype(np.uint32) * 961 + b[inside].astype(np.uint32) * 31 + c[inside]) * np.uint32(2654435761) >> np.uint32(16)
    bounds = np.cumsum([len(x) + 2 for x in raw])
    return code.astype(np.int64), np.searchsorted(bounds, inside, "right")


class TextModel:
    """Log-probabilities of the trigram buckets: one row for each language, the last for `und`."""

    def __init__(self, languages: list[str], logp: np.ndarray) -> None:
        self.languages, self.logp = languages, logp

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-likelihood by class, and the number of trigrams, of each text."""
        out, n = np.zeros((len(texts), len(self.logp))), np.zeros(len(texts), np.int64)
        for at, to in text_pieces(texts):
            code, doc = _trigrams(texts[at:to])
            n[at:to] = np.bincount(doc, minlength=to - at)
            for k, row in enumerate(self.logp):
                out[at:to, k] = np.bincount(doc, row[code], minlength=to - at)
        return out / np.maximum(n, 1)[:, None], n


def train(docs: DataFrame, fold: Column | None = None, folds: int = 1) -> list[TextModel]:
    """Models of the trigrams of all docs (text, lang) by language; rows without a language count for nothing.

    With folds (fold: a number from 0 for each row), the k-th model is counted from all folds but the k-th, so that a row
    can be judged without its own text and label; without, one model of all rows. What comes to the driver is a row for
    each fold, language and bucket that occurs: it grows with the languages, not with the documents.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (lang, k), part in batch.groupby(["lang", "fold"]):
                texts, sums = part["text"].tolist(), np.zeros(BUCKETS, np.int64)
                for at, to in text_pieces(texts):
                    sums += np.bincount(_trigrams(texts[at:to])[0], minlength=BUCKETS)
                seen = np.flatnonzero(sums)
                yield pd.DataFrame({"lang": lang, "fold": k, "bucket": seen, "n": sums[seen]})
        give_back()

    text_batches(docs.sparkSession)
    rows = docs.where("lang IS NOT NULL AND lang <> '' AND text IS NOT NULL").select("text", "lang", (F.lit(0) if fold is None else fold).cast("int").alias("fold"))
    found = rows.mapInPandas(count, "lang string, fold int, bucket int, n long").groupBy("lang", "fold", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((folds, len(languages) + 1, BUCKETS))
    for (lang, k), mine in found.groupby(["lang", "fold"]):
        counts[k, languages.index(lang), mine["bucket"]] = mine["n"]
    models = []
    for k in range(folds):
        used = counts.sum(axis=0) - (counts[k] if folds > 1 else 0)
        logp = np.log((used + 0.1) / (used.sum(axis=1, keepdims=True) + 0.1 * BUCKETS))
        logp[-1] = -np.log(BUCKETS)
        models.append(TextModel([*languages, UNKNOWN], logp))
    return models


def host_of(url: Column) -> Column:
    """Lower-case host of an address, without port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def declared_of(html: Column) -> Column:
    """Primary part of the markup's language attribute, or of its Content-Language; empty where there is none."""
    attribute = F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]+)", 1)
    header = F.regexp_extract(html, r"(?is)<meta\b[^>]*content-language[^>]*content\s*=\s*[\"']?([A-Za-z]+)", 1)
    return F.coalesce(F.lower(F.when(attribute != "", attribute).otherwise(header)), F.lit(""))


def text_of(html: Column) -> Column:
    """What a page shows: without comments, scripts, styles, navigation, tags and entities."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|nav)\b.*?</\1\s*>", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"&#?[A-Za-z0-9]+;", " ")


def identify(rows: DataFrame, models: list[TextModel]) -> DataFrame:
    """rows (id, text, declared, host, and fold where there are several models) -> id, lang, confidence, text_lang, declared, host, n_trigrams, accepted.

    A text's likelihood is the mean over all its trigrams, times their number or MOST, whichever is less: neighbouring
    trigrams are no independent evidence, and a long text shall not drown the rest. A row of fold k is judged by model k.

    lang is the class of the highest posterior, ties to the first in order. accepted: lang is not `und` and there is a
    trigram at all. Null or empty texts have no trigrams and are judged by the other evidence, but never accepted. Null
    declarations and hosts count as empty ones. Repeated rows each give a row; an empty table gives none.
    """
    fold = F.col("fold").cast("int") if len(models) > 1 else F.lit(0)
    texts = rows.select(F.col("id").cast("long").alias("id"), F.coalesce("declared", F.lit("")).alias("declared"), F.coalesce("host", F.lit("")).alias("host"), _evidence(rows, models, F.col("text"), fold).alias("e"))
    texts = materialize(texts.select("id", "declared", "host", "e.*"), "language_evidence")
    return _judged(texts, texts, models[0].languages).select("id", "lang", "confidence", "text_lang", "declared", "host", F.col("n").alias("n_trigrams"), "accepted")


def _evidence(rows: DataFrame, models: list[TextModel], text: Column, fold: Column) -> Column:
    """struct(ll array<double>, n long) of each text: its tempered log-likelihood by class, and its trigrams."""

    def likelihoods(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, folds in columns:
            mean, n = np.zeros((len(texts), len(models[0].logp))), np.zeros(len(texts), np.int64)
            for k, model in enumerate(models):
                mine = np.flatnonzero(folds.to_numpy() == k)
                mean[mine], n[mine] = model.score(texts.iloc[mine].tolist())
            yield pd.DataFrame({"ll": list(mean * np.minimum(n, MOST)[:, None]), "n": n})
        give_back()

    text_batches(rows.sparkSession)
    return F.pandas_udf(likelihoods, "ll array<double>, n long", PandasUDFType.SCALAR_ITER)(text, fold)


def _judged(texts: DataFrame, out: DataFrame, names: list[str]) -> DataFrame:
    """out with lang, confidence, text_lang and accepted, from the evidence of the table texts (declared, host, ll, n), whose columns out has too."""
    size = len(names)
    said = F.when(F.col("declared").isin(names), F.col("declared")).otherwise(F.lit(""))

    def best(scores: Column) -> Column:
        return F.get(F.array(*(F.lit(x) for x in names)), (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))

    # how often texts of a language declare what: (size + 1) x size counts at most
    seen = texts.where("n > 0").groupBy(said.alias("said"), best(F.col("ll")).alias("text_lang")).count().collect()
    declares = {(r["said"], r["text_lang"]): r["count"] for r in seen}
    claims = ["", *names]
    loglik = []
    for claim in claims:
        for lang in names:
            total = sum(declares.get((c, lang), 0) for c in claims)
            loglik.append(float(np.log((1 - NOISE) * (declares.get((claim, lang), 0) + 0.5) / (total + 0.5 * len(claims)) + NOISE / len(claims))))
    table = np.array(loglik).reshape(len(claims), size)
    claim_at = (F.coalesce(F.array_position(F.array(*(F.lit(x) for x in claims)), said), F.lit(1)) - 1).cast("int")
    start = np.array([(1 - UNKNOWN_SHARE) / max(1, size - 1)] * (size - 1) + [UNKNOWN_SHARE])

    def softmax(scores: np.ndarray) -> np.ndarray:
        powers = np.exp(scores - scores.max(axis=1, keepdims=True))
        return powers / powers.sum(axis=1, keepdims=True)

    def stacked(column: pd.Series) -> np.ndarray:
        return np.stack(column.to_numpy()) if len(column) else np.zeros((0, size))

    def alone(ll: pd.Series, claim: pd.Series) -> pd.Series:
        """The posterior of a text on a host that is not known."""
        return pd.Series(list(softmax(stacked(ll) + table[claim.to_numpy()] + np.log(start))))

    own = F.pandas_udf(alone, "array<double>")(F.col("ll"), claim_at)
    sums = texts.select("host", own.alias("p")).groupBy("host").agg(*(F.sum(F.get("p", F.lit(k))).alias(f"n{k}") for k in range(size)))
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    suffix = F.regexp_extract("host", r"([^.]+)$", 1)
    hosts = materialize(sums.select("*", F.when(domain == "", F.col("host")).otherwise(domain).alias("domain"), suffix.alias("suffix")), "language_hosts")
    ns = [f"n{k}" for k in range(size)]

    def counts(*key: str) -> DataFrame:
        return hosts.groupBy(*key).agg(F.array(*(F.sum(c) for c in ns)).alias(f"n_{key[-1] if key else 'all'}"))

    everywhere = counts().first()["n_all"]  # one number for each class
    found = hosts.select("host", "suffix", "domain", F.array(*ns).alias("n_host")).join(counts("suffix"), "suffix").join(counts("suffix", "domain"), ["suffix", "domain"])
    found = materialize(found.select(F.col("host").alias("p_host"), F.col("suffix").alias("p_suffix"), "n_suffix", "n_domain", "n_host"), "language_priors")
    joined = by_source(out, found, "host", "p_host")

    everywhere = np.array([float(x or 0) for x in everywhere])
    bonus = {suffix: COUNTRY_STRENGTH * (np.array(names) == lang) for suffix, lang in COUNTRIES.items()}
    none = np.zeros(size)

    def judge(ll: pd.Series, claim: pd.Series, suffix: pd.Series, n_suffix: pd.Series, n_domain: pd.Series, n_host: pd.Series) -> pd.DataFrame:
        """Each level's shares of the classes are drawn to those of the level above; a row's own evidence is taken out of all first."""
        evidence = stacked(ll) + table[claim.to_numpy()]
        mine, prior = softmax(evidence + np.log(start)), start
        extra = np.array([bonus.get(x, none) for x in suffix]).reshape(-1, size)
        for seen, more in ((everywhere, 0.0), (stacked(n_suffix), extra), (stacked(n_domain), 0.0), (stacked(n_host), 0.0)):
            rest = np.maximum(0, seen - mine) + more
            prior = (rest + STRENGTH * prior) / (rest.sum(axis=1, keepdims=True) + STRENGTH)
        scores = evidence + np.log(prior)
        return pd.DataFrame({"best": scores.argmax(axis=1), "sure": softmax(scores).max(axis=1), "text": stacked(ll).argmax(axis=1)})

    # said not to repeat itself, or a filter on what it finds would run it once more, in a second worker of each task
    found = F.pandas_udf(judge, "best int, sure double, text int").asNondeterministic()(F.col("ll"), claim_at, F.col("p_suffix"), F.col("n_suffix"), F.col("n_domain"), F.col("n_host"))
    out = joined.withColumn("judged", found).drop("p_suffix", "n_suffix", "n_domain", "n_host")
    name = lambda at: F.get(F.array(*(F.lit(x) for x in names)), at)
    out = out.withColumns({"lang": name(F.col("judged.best")), "confidence": F.col("judged.sure"), "text_lang": F.when(F.col("n") > 0, name(F.col("judged.text")))}).drop("judged")
    return out.withColumn("accepted", (F.col("n") > 0) & (F.col("lang") != UNKNOWN))


def identify_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Languages of pages (page_id, url, html) with trigrams from docs (text, lang); see identify()."""
    rows = pages.select(F.col("page_id").alias("id"), text_of(F.col("html")).alias("text"), declared_of(F.col("html")).alias("declared"), host_of(F.col("url")).alias("host"))
    return identify(rows, train(docs)).withColumnRenamed("id", "page_id")


def keep_identified(docs: DataFrame, sure: float = 0.5, folds: int = 2) -> DataFrame:
    """docs (doc_id, text, lang, source) in one of the languages of docs, lang being the language found; the other columns stay as they are.

    The lang column is the declaration, the source the host. A document goes if its text holds no trigram, is explained
    by no language, or if the posterior of the best is below `sure`. Each text is judged by a model that is counted from
    the other folds (by a hash of doc_id) alone, so that its own label weighs as the declaration only. A row with a null
    doc_id stays as it is if its text holds a letter. Repeated rows each are judged; an empty table gives none.

    The rows are written once with their evidence and judged where they lie: no table of texts is joined by document.
    """
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int")
    named = docs.where("doc_id IS NOT NULL")
    models = train(named, fold, folds)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    rows = named.select(whole, F.coalesce(F.lower("lang"), F.lit("")).alias("declared"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), _evidence(docs, models, F.col("text"), fold).alias("e"))
    rows = materialize(rows.select("whole", "declared", "host", "e.*"), "language_evidence")
    kept = _judged(rows.drop("whole"), rows, models[0].languages).where(F.col("accepted") & (F.col("confidence") >= sure))
    kept = kept.select(*((F.col("lang").alias(c) if c == "lang" else F.col("whole")[c].alias(c)) for c in docs.columns))
    return kept.union(docs.where(F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))))
