"""A training-data pipeline over the documents table, in stages that each call one operator.

Cases: every stage takes null doc_ids, null, empty and very long texts, repeated rows and empty tables, and reads the five columns of documents
alone, so further ones may have clashing names.  Texts that are null or without a letter go in the first stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stockloom.llm import hilbert_packing, language_id, line_windows, simhash_bktree, source_mixing
from stockloom.llm.common import Tables, narrow, read_table
from stockloom.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go (operator 7): null texts, texts without a letter, and scores below 0.5; a null lang
    is filled with the prediction."""
    return language_id.keep_identified(narrow(docs, *COLUMNS))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go; documents that they leave blank go too (operator 6).  Texts under three lines stay."""
    return line_windows.drop_repeated_lines(narrow(docs, *COLUMNS))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: Jaccard similarity of 0.8 or more on 5-word shingles (operator 8).  Rows
    without a doc_id stay, all of them; rows that repeat both doc_id and text count as one document."""
    return simhash_bktree.drop_similar(narrow(docs, *COLUMNS), width=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words in the shares of the source weights; a row for each document and epoch (operator 4).  A null source is one of its own."""
    return source_mixing.mixed_documents(narrow(docs, *COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids, with the ids (operator 9).  Rows alike in doc_id are documents each."""
    return hilbert_packing.pack(narrow(docs, *COLUMNS), tokenizer_path())


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_documents),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the trained classifier, the fingerprints' words or the tokenizer; tests/llm/test_brute_force.py holds each stage
#: against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that the one before it kept, each written as Parquet and read again."""
    tables, docs = Tables(spark), read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = tables.keep(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
