"""Documents to packed training examples, in five stages.

Each stage is written as Parquet to the shared folder and read again, so a lost
executor costs at most the stage it was in.

All stages but the last return the columns they get, whatever further ones there are and
however they are named, and take an empty table. What they do with odd rows is in their
docstrings; nulls in other columns than those named there don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagework.llm import langid, packing, quality_mil, simhash, suffix_index
from passagework.session import fresh_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, doesn't reject.

    Null, empty and blank texts go. Rows are judged one by one: repeated ones alike, those without an id too.
    """
    return quality_mil.keep_good(docs, quality_mil.train(docs, table(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear, and isn't another than the one they declare.

    Null, empty and blank texts go. A null or unknown ``lang`` declares nothing. Repeated rows are judged alike.
    """
    return langid.keep_identified(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id.

    Null and wordless texts are no duplicates of each other and stay, as do rows without an id. Rows of one id are
    one document: all of them stay or go.
    """
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that occurred before, in the order of doc_id.

    Texts that are left blank go; null texts and rows without an id stay as they are. Rows of one id are copies of
    one place and are cut alike.
    """
    return suffix_index.cut_repeats(docs)


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, pack_id, position, tokens, segments, loss_tokens, start_token, end_token) of every document.

    All tokens of a document bear loss, so their limit is that of tokens. Null texts have none and still get a
    place; rows without an id get none; rows of one id are one document.
    """
    limits = packing.LIMITS | {"loss_tokens": packing.LIMITS["tokens"]}
    return packing.pack(packing.documents_demand(docs), limits).withColumnRenamed("example_id", "doc_id")


STAGES = [
    ("quality classifier", quality),
    ("language id", language),
    ("near duplicates", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("packing", packs),
]

#: Models, fingerprints and the packing heuristic have no SQL. The tests hold the rows of every stage against a plain
#: version: document by document, all pairs, a table of all windows, and a loop over the packs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = fresh_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
