"""A training corpus from the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import langid, mixing, nearcopies, secrets, spm
from loomwork.llm.common import drop_paths, materialize, read_table, watching

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages of the table."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies.

    Near copies are texts whose five-word shingles have a Jaccard similarity of 0.8 or more, and a group is what such
    links connect: two of its documents may be less alike. SimHash (six bits) and an exact key only propose links.
    """
    return nearcopies.keep_first(docs, radius=6)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them, repeats as rows; weighed by their own text, as labels cover a part of them only."""
    return mixing.repeated(docs, mixing.quality_of(F.col("text")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, checked by decoding."""
    return spm.encode(docs)


STAGES: list[tuple[str, Stage]] = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("secret scans", secret_scan), ("mixing to target weights", mix), ("SentencePiece encoding", tokens)]

#: The stages hash, sample and tokenise as SQL cannot.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. What a stage has made goes when its rows are written, and these when the next stage's are.

    A stage on its own deletes nothing that its result reads.
    """
    docs, before = read_table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        last = k == len(STAGES) - 1
        with watching() as made:
            docs = stage(spark, docs, sf_dir)
            docs = docs if last else materialize(docs, f"stage-{k}")
        if not last:
            drop_paths(spark, [*before, *made[:-1]])
            before = made[-1:]
    return docs
