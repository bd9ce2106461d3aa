"""From raw documents to a binary training set: filter, deduplicate, decontaminate, mix, encode.

Each stage is one operator of ``meshwork.llm`` on all that the stage before has
kept; between stages the documents are written as Parquet, in files of a set number
of rows, and read again. Rows are told apart as rows: null and repeated ids, null and
empty texts, extra columns and empty tables pass through every stage as the operators'
docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshwork.llm import decontamination, mixing, near_copies, quality, simhash, token_store
from meshwork.llm.queries import table, tokenizer_file
from meshwork.session import files_for, materialize


def _filed(out: DataFrame, docs: DataFrame) -> DataFrame:
    """``out`` in as many tasks as the files that ``docs`` fill."""
    return out.coalesce(files_for(docs.count()))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return _filed(quality.keep_good(docs, table(spark, sf_dir, "labels")), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, Jaccard similarity of 0.8 at least."""
    return _filed(simhash.one_of_each(docs, near_copies.near_copies), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return _filed(decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark")), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return _filed(mixing.mixed_documents(docs), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in binary shards; what the files say of each document."""
    return token_store.round_trip(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality", good_quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token_store", encode),
]

#: SQL has neither the classifier nor the tokenizer. Tests hold each stage on its own input: near_dedup and token_store against
#: brute force, the others against the operator's own decisions, which tests of the operators hold against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
