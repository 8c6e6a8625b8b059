"""A training-corpus pipeline over ``documents``: each stage works on all rows that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sleuthframe.llm import jaccard_join, line_dedup, packing, toxicity
from sleuthframe.llm.tables import materialize, read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones among them, does not call toxic.

    Rows with null or empty texts are kept; repeated rows stay or go together; an empty table stays empty; extra columns of any
    name are kept as they are.
    """
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without the lines that it shares with two others or more, unless it is the last to hold them.

    Null texts become empty, n_chars is counted anew where there is one; repeated rows are treated alike; an empty table stays
    empty; extra columns of any name are kept as they are.
    """
    return line_dedup.without_shared_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near duplicates: five-word shingles, Jaccard index of 0.8 or more.

    Documents without words, or without a doc_id, are duplicates of none; of rows that share a doc_id one stays; an empty table
    stays empty; extra columns of any name are kept as they are.
    """
    return jaccard_join.without_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in sequences of up to 2048 tokens.

    A null or empty text is one end token; repeated rows are documents of their own; an empty table gives no rows; extra columns
    are not read.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [("toxicity", drop_toxic), ("line_dedup", drop_shared_lines), ("ngram_jaccard_join", drop_near_duplicates), ("best_fit_packing", pack)]

#: Classification and packing have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
