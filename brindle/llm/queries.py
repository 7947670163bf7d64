"""One query per operator of this subpackage, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, ctph, decontam, langid, licenses, pii, quality, records, repair, ring, simhash, toxicity, trie
from brindle.llm.shared import Scratch, range_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return found.withColumn("kept", quality.kept()).drop("clean")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    found = langid.predict(docs, langid.train(docs.where(fold != 2)))
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), key=pii.TEST_KEY)


def op8_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.read_documents(spark, table(spark, sf_dir, "documents"))


def op9_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.neighbours(table(spark, sf_dir, "documents"))


def op10_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring.shard(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, turns = Scratch(spark, "trie"), trie.digests(table(spark, sf_dir, "conversations"))
    conv, parts = F.col("conv_id"), range_count(turns, 1)
    rebuilt = trie.grafted(scratch, turns, conv - conv % 100, F.crc32(conv.cast("string")) % 6, 5, parts)
    found = trie.build(scratch, rebuilt, ["part", "turn"], parts, turns.select("conv_id").distinct())
    nodes = found.nodes.join(trie.ends_digest(found.members), ["key1", "key2", "depth"], "left")
    sha = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), sha)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = repair.damaged(table(spark, sf_dir, "conversations"))
    return repair.digested(turns, Scratch(spark, "repair").put(repair.examine(turns)))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents").select("doc_id", "text"), F.crc32(F.col("doc_id").cast("string")) % 3
    model = toxicity.train(docs.where(fold != 1), table(spark, sf_dir, "labels"), docs)
    held_out = F.coalesce(fold == 1, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op1_simhash": op1_simhash, "op2_decontaminate": op2_decontaminate, "op3_quality": op3_quality, "op4_langid": op4_langid, "op5_licenses": op5_licenses, "op6_bpe": op6_bpe, "op7_pii": op7_pii, "op8_records": op8_records, "op9_ctph": op9_ctph, "op10_ring": op10_ring, "op11_trie": op11_trie, "op12_repair": op12_repair, "op13_toxicity": op13_toxicity}
ORACLE: dict[str, str] = {"op5_licenses": licenses.oracle_sql(), "op11_trie": trie.oracle_sql(), "op12_repair": repair.oracle_sql()}
