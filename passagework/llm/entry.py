"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import bond, bpe, langid, licenses, media, packing, quality_mil, simhash, suffix_index, zip_warc
from passagework.session import table


def op1_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_mil.score(docs, quality_mil.train(docs, table(spark, sf_dir, "labels")))


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.conversations_demand(table(spark, sf_dir, "conversations"))).withColumnRenamed("example_id", "conv_id")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives its text back."""
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), bpe.Vocabulary.read())


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.mark(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.repeats(table(spark, sf_dir, "documents"))


def op8_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to ZIP packages of WARC records and read out of them by ranges."""
    return zip_warc.read_back(table(spark, sf_dir, "pages"))


def op9_avi_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of the films that are made of every page, as no table has a media column."""
    found = media.clips(media.with_films(table(spark, sf_dir, "pages")))
    return found.withColumns({c: F.round(c, 6) for c in ("start_s", "end_s")})


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours, among all vectors, of every vector whose id is divisible by 20."""
    return bond.topk(table(spark, sf_dir, "embeddings"), asked="id % 20 = 0").withColumn("distance", F.round("distance", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_mil, op2_vector_packing, op3_byte_bpe, op4_language_id, op5_simhash_groups, op6_license_scan, op7_repeated_passages, op8_zip_warc, op9_avi_shots, op10_exact_topk)}

ORACLES: dict[str, str] = {"op7_repeated_passages": suffix_index.ORACLE, "op8_zip_warc": zip_warc.ORACLE, "op9_avi_shots": media.ORACLE, "op10_exact_topk": bond.ORACLE}
