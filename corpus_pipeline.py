"""Corpus pipeline: language filter, near-duplicates, repeated passages, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; every stage but the last returns the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, language_id, sentencepiece_bpe, simhash, substrings
from tessera.llm.common import read, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go: null, no letters at all, or a score below language_id.least_score().

    Rows are judged by their text alone, so rows that repeat stay or go together.
    """
    return language_id.reject_unknown(docs, language_id.learn(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the rows of the smallest doc_id stay, each judged by its own text.

    Rows that repeat doc_id and text stay or go together; of a doc_id with two
    texts each row belongs to its text's component.  A null doc_id stays.
    """
    return simhash.without_duplicates(docs)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id has are cut; a document that loses all its words goes.

    Rows of one doc_id take nothing from each other; a null doc_id loses nothing and stays, a null text stays.
    """
    kept = substrings.without_repeats(docs)
    return kept.where(~F.coalesce(F.trim("text") == "", F.lit(False)) | F.col("doc_id").isNull())


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; a null text is clean, rows that repeat stay or go together."""
    return decontamination.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, encoded with the pieces model and decoded again; a null text is empty, each row gives one row."""
    import public_tokenizers

    model = sentencepiece_bpe.load_model(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece_bpe.digests(sentencepiece_bpe.encode_texts(docs, model))


STAGES = [
    ("language id", known_language),
    ("near duplicates", one_of_each),
    ("repeated passages", no_repeated_passages),
    ("decontamination", decontaminate),
    ("encoding", encode),
]

#: Language identification and encoding have no SQL; tests/llm compares the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to `documents`; each stage's result is written and read again as the next one's input."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(spark, docs, name.replace(" ", "-"))
    return docs
