"""Secret scan with DataFrame functions only: fixed patterns, and character Markov models for the rest.

Two first-order Markov models over characters, of random strings and of ordinary identifiers, are counted from labelled
samples. A long token is a secret where the log-likelihood ratio of the two models is above a threshold, in all and for
each character. Spans of the patterns always stay; the models add spans that touch none of them.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import fresh

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of one class of characters is the same whether its length is asked for in the pattern or afterwards.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: What the models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "markov")
#: Characters of the models; all others count as one more.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
#: Documents that give labelled samples, about: those whose hash falls into one of count / SAMPLE_DOCS parts.
SAMPLE_DOCS = 5_000
#: Weight of the class's character frequencies in each row of transitions, and of the even spread in those.
ROW_PRIOR, EVEN_PRIOR = 20.0, 500.0
#: Log-likelihood ratio (natural) that a secret has at least, in all and for each character.
TOTAL, EACH = 12.0, 0.6
#: Spans of one text that are folded together.
CHUNK = 128
SPAN = "struct<start:int,kind:int,end:int>"


def labelled_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(sample, random boolean) from about `sample_docs` documents: values of assignments and keys are random strings, other tokens of 8 or more letters, digits, - or _ are ordinary unless they mix letters and digits."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = ceil(max(1, docs.count()) / sample_docs)
    chosen = docs.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), text), F.lit(parts)) == 0)
    secret = F.concat(F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 12), F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), F.regexp_extract_all(text, F.lit(HEX), F.lit(0)))
    plain = F.filter(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_-]{8,}"), F.lit(0)), lambda w: ~w.rlike("[0-9]"))
    return chosen.select(F.explode(F.array(F.struct(secret.alias("s"), F.lit(True).alias("random")), F.struct(plain.alias("s"), F.lit(False).alias("random")))).alias("c")).select(F.explode("c.s").alias("sample"), "c.random")


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of the transitions, by (code of the first character) * size + (code of the second).

    samples: (sample string, random boolean); null samples count for nothing. Counted by grouped aggregation; what comes
    to the driver is at most two rows for each pair of the alphabet. A class without samples is an even spread.
    """
    size = len(ALPHABET) + 1
    codes = F.transform(F.split("sample", ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.transform(F.sequence(F.lit(1), F.size("codes") - 1), lambda i: F.element_at("codes", i) * size + F.element_at("codes", i + 1))
    coded = samples.where("length(sample) > 1").select("random", codes.alias("codes")).where("size(codes) > 1")
    counts = coded.select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count().collect()
    logs = {}
    for random in (True, False):
        table = {r["pair"]: r["count"] for r in counts if r["random"] == random}
        second = [EVEN_PRIOR / size] * size
        first = [0.0] * size
        for pair, n in table.items():
            second[pair % size] += n
            first[pair // size] += n
        total = sum(second)
        logs[random] = [log((table.get(a * size + b, 0) + ROW_PRIOR * second[b] / total) / (first[a] + ROW_PRIOR)) for a in range(size) for b in range(size)]
    return [r - o for r, o in zip(logs[True], logs[False], strict=True)]


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of random against ordinary for a token of two or more characters."""
    size = len(ALPHABET) + 1
    table = F.lit(model)

    def code(i: Column) -> Column:
        return F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))

    return F.aggregate(F.sequence(F.lit(2), F.length(token)), F.lit(0.0), lambda total, i: total + F.get(table, code(i - 1) * size + code(i)))


def _chunked(items: Column, start: Column, step, end, into: str) -> Column:
    """A fold over an array that collects an array: step(done, item) gives `at` and an array `out`, which begins empty in each chunk.

    Chunks of CHUNK items are folded by themselves and joined at the end, so that work grows with the items and not with
    their square. end(done, inner) gives what a chunk's fold is kept as, of type `into`.
    """
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda c: F.slice(items, c * CHUNK + 1, CHUNK))

    def fold(done: Column, chunk: Column) -> Column:
        # an array of one binds the chunk's result, or it would be worked out for each use
        inner = F.transform(F.array(step(done, chunk)), lambda x: F.struct(x["at"].alias("at"), F.array_append(done["out"], end(x["out"])).alias("out")))
        return F.get(inner, F.lit(0))

    return F.aggregate(chunks, F.struct(start.alias("at"), F.array().cast(f"array<{into}>").alias("out")), fold)


def _places(text: Column, pattern: str, matches: Column, kind: str) -> Column:
    """array<struct(start, kind, end)> of the matches of a pattern, in code points."""
    gaps = F.split(text, pattern, -1)
    kind_at = F.lit(KINDS.index(kind))
    none = F.array().cast(f"array<{SPAN}>")

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        end = start + x["match"]
        return F.struct(end.alias("at"), F.array_append(done["out"], F.struct(start.alias("start"), kind_at.alias("kind"), end.alias("end"))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("match")))
    folded = _chunked(pairs, F.lit(0), lambda done, chunk: F.aggregate(chunk, F.struct(done["at"].alias("at"), none.alias("out")), step), lambda out: out, f"array<{SPAN}>")
    return F.when(F.size(matches) > 0, F.flatten(folded["out"])).otherwise(none)


def _where(spans: Column, matches: Column, good) -> Column:
    """The spans whose match is good."""
    both = F.zip_with(spans, matches, lambda s, m: F.struct(s.alias("s"), m.alias("m")))
    return F.transform(F.filter(both, lambda x: good(x["m"])), lambda x: x["s"])


def find(docs: DataFrame, model: list[float], text: str = "text") -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names, which docs does not have: the spans of the patterns, and all spans.

    Spans are array<struct(start, kind, end)>, sorted by start, then kind; a null text is empty.
    """
    parts = ("assign", "access", "hex", "candidate", "a", "h", "ratio", "m", "base", "all")
    names = {n: fresh(docs, f"_{n}") for n in parts}
    col = {n: F.col(names[n]) for n in parts}
    body = F.coalesce(F.col(text), F.lit(""))
    none, no_spans = F.array().cast("array<string>"), F.array().cast(f"array<{SPAN}>")

    def all_of(pattern: str, gate: Column) -> Column:
        return F.when(gate, F.regexp_extract_all(body, F.lit(pattern), F.lit(0))).otherwise(none)

    signs = F.contains(body, F.lit("=")) | F.contains(body, F.lit(":"))
    rows = docs.withColumns({
        names["assign"]: all_of(ASSIGN, signs), names["access"]: all_of(ACCESS, F.contains(body, F.lit("AKIA"))),
        names["hex"]: all_of(HEX, F.lit(True)), names["candidate"]: all_of(CANDIDATE, F.lit(True)),
    })
    rows = rows.withColumns({
        names["a"]: _where(_places(body, ASSIGN, col["assign"], "assign"), col["assign"], lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12),
        names["h"]: F.concat(_places(body, ACCESS, col["access"], "access"), _places(body, HEX, col["hex"], "hex")),
        names["ratio"]: F.when(F.size(col["candidate"]) > 0, F.transform(col["candidate"], lambda c: ratio(c, model))).otherwise(F.array().cast("array<double>")),
    })
    suspect = F.exists(F.zip_with(col["candidate"], col["ratio"], lambda c, r: (r >= TOTAL) & (r >= EACH * F.length(c))), lambda x: x)
    rows = rows.withColumns({names["base"]: F.array_sort(F.concat(col["a"], col["h"])), names["m"]: F.when(suspect, _places(body, CANDIDATE, col["candidate"], "markov")).otherwise(no_spans)})
    judged = F.filter(F.zip_with(col["m"], col["ratio"], lambda s, r: F.struct(s.alias("s"), r.alias("r"))), lambda x: x["s"].isNotNull() & (x["r"] >= TOTAL) & (x["r"] >= EACH * (x["s"]["end"] - x["s"]["start"])))
    free = F.filter(F.transform(judged, lambda x: x["s"]), lambda s: ~F.exists(col["base"], lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
    rows = rows.withColumn(names["all"], F.array_sort(F.concat(col["base"], free)))
    return rows.drop(*(names[n] for n in parts[:-2])), names["base"], names["all"]


def _text_of(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: int):
    return lambda span: span["kind"] == kind


def scan(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov.

    spans are kind:start:end, comma-joined, by start and then kind; code points, end exclusive. Null texts are empty and
    hold none; repeated rows each give a row; an empty table gives none; other columns are ignored. Without a model one
    is trained from docs.
    """
    model = train(labelled_samples(docs)) if model is None else model
    found, base, every = find(docs.select("doc_id", "text"), model)
    counts = [F.size(F.filter(every, _is(i))).cast("long").alias(f"n_{KINDS[i]}") for i in range(4)]
    return found.select("doc_id", *counts[:3], F.sha2(_text_of(F.col(base)).cast("binary"), 256).alias("base_sha256"), _text_of(F.col(every)).alias("spans"), counts[3])


def redact(docs: DataFrame, model: list[float] | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret span of the text replaced by `mark` and n_chars, where there is one, counted again.

    Spans that overlap become one mark. Null texts stay null, repeated rows each give a row, an empty table gives none.
    """
    model = train(labelled_samples(docs)) if model is None else model
    found, _, every = find(docs, model)
    text, spans = F.col("text"), F.col(every)

    def chunk(done: Column, some: Column) -> Column:
        """The pieces from where the last chunk ended to the end of this one; places are counted within that stretch of text."""
        begin, until = done["at"], F.greatest(done["at"], F.array_max(F.transform(some, lambda s: s["end"])))
        held = F.array(F.substring(text, begin + 1, until - begin))

        def step(stretch: Column):
            def one(state: Column, s: Column) -> Column:
                more = F.concat(state["out"], F.array(F.substring(stretch, state["at"] - begin + 1, s["start"] - state["at"]), F.lit(mark)))
                return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], more).otherwise(state["out"]).alias("out"))

            return one

        empty = F.struct(begin.alias("at"), F.array().cast("array<string>").alias("out"))
        return F.get(F.transform(held, lambda stretch: F.aggregate(some, empty, step(stretch))), F.lit(0))

    whole = F.transform(F.array(_chunked(spans, F.lit(0), chunk, lambda out: F.array_join(out, ""), "string")), lambda x: F.concat(F.array_join(x["out"], ""), F.substring(text, x["at"] + 1, F.length(text))))
    out = found.withColumn("text", F.when(F.size(spans) > 0, F.get(whole, F.lit(0))).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
