"""A training corpus in five stages; each gets what the stage before kept, written as Parquet and read again.

1. quality: rows that the quality classifier rejects go.
2. near_dedup: one document of each near-duplicate group (five-word shingles, similarity 0.8 or more) stays, that with the least id.
3. decontaminate: documents with any benchmark window go.
4. pii: personal data is replaced by surrogates; n_chars is counted anew.
5. tokens: byte-level BPE; adds n_tokens, ids_sha256, decoded_sha256 and token_ids (little-endian unsigned 32-bit integers).

All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, decontam, pii, quality, similar, simhash
from brindle.llm.shared import Scratch


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.select(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, find=similar.near_duplicates)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kind = docs.schema["n_chars"].dataType
    return pii.surrogates(docs, key=pii.TEST_KEY, spans=False).withColumn("n_chars", F.length("text").cast(kind))


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, ids=True)


STAGES = [("quality", _quality), ("near_dedup", _near_dedup), ("decontaminate", _decontaminate), ("pii", _pii), ("tokens", _tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each stage's rows are written to the shared folder before the next reads them."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir))
        if number:
            scratch.drop(number)  # the rows of the stage before
    return docs
