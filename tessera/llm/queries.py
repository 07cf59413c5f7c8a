"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, fingerprint, langid, mixing, mpegts, neardup, pii, toxicity, unitdedup, wacz
from tessera.llm.shared import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.duplicate_groups(documents(spark, sf_dir))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


def op3_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unitdedup.removals(documents(spark, sf_dir))


def op4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.fit(docs))


def op5_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.demux(mpegts.page_media(table(spark, sf_dir, "pages")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir).select("doc_id", "text"))


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(documents(spark, sf_dir))


def op10_web_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wacz.read_pages(wacz.pack(table(spark, sf_dir, "pages"), Scratch(spark, "wacz")))


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_fingerprints, op3_repeated_lines, op4_languages, op5_transport_streams, op6_toxicity, op7_pii, op8_byte_bpe, op9_mixture, op10_web_archives)}
ORACLE_SQL = {"op3_repeated_lines": unitdedup.ORACLE, "op9_mixture": mixing.oracle(), "op10_web_archives": wacz.ORACLE}
