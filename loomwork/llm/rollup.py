"""Delta-maintained token totals by source, language and tokenizer version.

A batch holds signed rows: inserted and deleted documents, and revised counts as a deletion of the old and an insertion of
the new. It is summed by key and committed as one folder of the ledger, whose name is the batch's id; the folder appears
only when it is whole, and a batch whose folder is there is not applied again, so replays change nothing. Each writer of a batch
has a staging folder of its own, and of several one alone puts its folder in place. Totals are sums over the ledger.
"""

from __future__ import annotations

import base64
import uuid
from functools import lru_cache

import tiktoken
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import map_texts, materialize
from loomwork.llm.mixing import words
from loomwork.llm.spm import read_model

#: Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KEYS = ["source", "lang", "tokenizer"]
MEASURES = ["docs", "tokens"]


def inserts(counts: DataFrame, sign: int = 1) -> DataFrame:
    """Signed rows of counts (source, lang, tokenizer, n_tokens): sign 1 inserts them, -1 deletes them; null counts are 0."""
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("docs"), (F.lit(sign) * F.coalesce(F.col("n_tokens"), F.lit(0))).cast("long").alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows that replace old counts by new ones."""
    return inserts(old, -1).union(inserts(new))


class Ledger:
    """Committed batches under a path of the shared folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        root = self._fs_path(self.path)
        found = self._fs.listStatus(root) if self._fs.exists(root) else []
        return sorted(x.getPath().getName()[6:] for x in found if x.getPath().getName().startswith("batch="))

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Add a batch of signed rows; False, and nothing done, if the batch is there already. An empty batch counts as committed too."""
        if batch in self.committed():
            return False
        sums = signed.groupBy(*KEYS).agg(*(F.sum(m).alias(m) for m in MEASURES))
        part, jvm = self._fs_path(f"{self.path}/.part-{batch}-{uuid.uuid4().hex}"), self.spark._jvm
        sums.write.parquet(part.toString())
        options = jvm.org.apache.hadoop.fs.Options
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            # unlike FileSystem.rename, this moves nothing into a folder that is there
            context.rename(part, self._fs_path(f"{self.path}/batch={batch}"), self.spark.sparkContext._gateway.new_array(options.Rename, 0))
        except Py4JJavaError as error:
            self._fs.delete(part, True)
            if batch in self.committed():
                return False
            raise OSError(f"batch {batch} could not be committed") from error
        return True

    def totals(self) -> DataFrame:
        """Sums of all committed batches; keys whose documents and tokens are all gone are left out. Null keys are keys."""
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        batches = [f"{self.path}/batch={b}" for b in self.committed()]
        rows = self.spark.read.schema(schema).parquet(*batches) if batches else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(*(F.sum(m).alias(m) for m in MEASURES)).where("docs <> 0 OR tokens <> 0")


@lru_cache(maxsize=2)
def _coder(raw: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, vocabulary: str, name: str) -> DataFrame:
    """docs (doc_id, text, source, lang) with tokenizer and n_tokens; the text goes, its MD5 stays. Null texts have 0 tokens.

    vocabulary: a file of base64 tokens and ranks for byte-level pair encoding; the driver reads it, tasks get its bytes.
    """
    raw = read_model(docs.sparkSession, vocabulary)

    def make():
        coder = _coder(raw)
        return lambda texts: {"n_tokens": [0 if t is None else len(coder.encode_ordinary(t)) for t in texts]}

    rows = docs.select("doc_id", "source", "lang", F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    return map_texts(rows, "text", make, "n_tokens long", ["doc_id", "source", "lang", "digest"]).withColumn("tokenizer", F.lit(name))


def maintain(docs: DataFrame, vocabulary: str, name: str, path: str) -> DataFrame:
    """Totals of docs after four batches: all documents by words; all again under a tokenizer, with their words as estimates; these revised to its tokens; exact copies deleted.

    So the rows of the tokenizer "words" count every document, and those of `name` every text. The batches are committed to the ledger at path; each is sent twice, as after a lost acknowledgement.
    A copy is a document whose text equals that of a document with a smaller doc_id. Null texts are no copies. Repeated
    rows (equal doc_id and text) count each until the last batch, which keeps one. An empty table gives no totals.
    """
    spark = docs.sparkSession
    counted = materialize(count_tokens(docs, vocabulary, name), "token_counts")
    by_words = docs.select("source", "lang", F.lit("words").alias("tokenizer"), words(F.col("text")).alias("n_tokens"))
    # the signed rows of a group of copies: all of it out, its first document in again
    known = counted.where("digest IS NOT NULL")
    firsts = known.groupBy("digest").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "source", "lang", "tokenizer", "n_tokens")).alias("first")).select("first.*")
    ledger = Ledger(spark, path)
    estimates = by_words.withColumn("tokenizer", F.lit(name))
    batches = {"1-words": inserts(by_words), "2-estimates": inserts(estimates), "3-revise": revisions(estimates, counted), "4-copies": inserts(known, -1).union(inserts(firsts))}
    for _ in range(2):
        for batch, signed in batches.items():
            ledger.commit(batch, signed)
    return ledger.totals()
