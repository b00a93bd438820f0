"""Corpus cleaning: STAGES in order, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import codec, jaccard_join, line_dedup, mixing, quality, shared


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go, and those of fewer than ten words, so null and empty texts.

    Each row is judged by its text alone, however long; ids may be null or repeated, other columns
    stay as they are, and an empty table stays empty.
    """
    return quality.keep(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; n_chars follows the text.

    A null text stays null. Rows that repeat an id are lines of one document; a null id is one
    document too. Of equal lines those of the largest id stay. Other columns stay as they are,
    whatever their names; a very long text is one row; an empty table stays empty.
    """
    return line_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id, nulls last.

    Documents without words stay, as do rows that repeat the id and text of one that stays. Other
    columns stay as they are; a very long text is one set; an empty table stays empty.
    """
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their targets.

    A null source is a source; a document without words has no weight in its source's size, and is
    drawn like others. Rows that repeat id and text are drawn alike. Other columns stay as they are;
    a very long text moves with its row; an empty table stays empty.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix, and their and the decoded bytes' hashes.

    A null text has none. Copies encode alike, ids may be null or repeated, other columns go. A very
    long text is one row; an empty table stays empty.
    """
    return codec.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules),
    ("drop_repeated_lines", drop_repeated_lines),
    ("drop_near_copies", drop_near_copies),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: Suffix arrays, components and merge replay have no SQL form; a test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared.folder(spark, name)
        with shared.scope(spark):  # a stage's own tables go with it
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
