"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

All but the last stage return the columns of documents. Each takes
``(spark, docs, sf_dir)``, works on every row that its predecessor kept, and its
decisions take effect: toxic documents go, one document of each near-duplicate
group stays, personal data is masked, sources are brought to their target
weights by dropping and repeating documents, and the rest becomes tokens.

Defined results: the rules of the five operators, one after the other. A null, empty or
blank text is never toxic nor a copy, and leaves at the mixing, which draws no null or
empty text (a blank one can be drawn); so do rows with a null doc_id or source, which pass
the first three stages. Rows repeated with one doc_id are one document: they stay or go
together, and each is repeated as often as the document was drawn. Empty tables give no
rows, and without labels of both classes nothing is toxic. Other columns pass through,
whatever their names, but ``tokens``, ``n_tokens`` and ``round_trip``, which the last stage
writes anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, mixing, neardup, pii, toxicity
from tessera.llm.shared import Scratch

#: No stage but the mixing is expressible in SQL; tests compare them with brute force.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the recurrent network, trained on ``labels``, rejects."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least doc_id of each group of near and exact copies."""
    return neardup.keep_one(docs)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and secrets by their kind."""
    return pii.mask(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bring the sources to their target weights."""
    return mixing.mix(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the round trip checked."""
    return bpe.encode_documents(docs)


STAGES = [("toxicity", without_toxic), ("near_dedup", without_near_duplicates), ("pii", without_pii), ("mixing", mixed), ("byte_bpe", tokenised)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.write(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
