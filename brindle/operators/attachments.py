"""The life of uploaded documents: create, parse, index, delete, reclaim, as steps on the documents table and the vectors table.

Each step takes the rows it applies to and gives the new tables; a step that is run again on its own result changes nothing, so an interrupted
flow is resumed by running it again. Expired documents are checked again right before their vectors are published.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators import relational
from brindle.operators.spread import dealt


def move(documents: DataFrame, ids: DataFrame, target: str, now: Column, sources: list[str] | None = None) -> DataFrame:
    """Documents named in ids that may go to ``target`` (from ``sources``, or from any state that allows it) are moved there."""
    allowed = sources or [s for s, t in relational.TRANSITIONS.items() if target in t]
    mark = ids.select("id").distinct().withColumn("__m", F.lit(True))
    go = F.coalesce(F.col("__m"), F.lit(False)) & F.col("status").isin(allowed)
    rows = documents.join(mark, "id", "left").withColumn("updated_at", F.when(go, now).otherwise(F.col("updated_at")))
    return rows.withColumn("status", F.when(go, target).otherwise(F.col("status"))).select(*documents.columns)


def create(documents: DataFrame, requests: DataFrame, sessions: DataFrame, now: Column, hours: int = 24, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """New documents of requests (id, user_id, session_id, ...), and the refused requests with ``problem``: session_missing, not_owner, quota."""
    from pyspark.sql import Window

    checked = relational.attach_problems(requests, sessions)
    active = documents.where(F.col("status").isin(relational.ACTIVE)).groupBy("session_id").agg(F.count("*").alias("__have"))
    n = F.row_number().over(Window.partitionBy("session_id", F.col("problem").isNull()).orderBy("id"))
    checked = checked.join(active, "session_id", "left").withColumn("problem", F.when(F.col("problem").isNull() & (F.coalesce("__have", F.lit(0)) + n > most), "quota").otherwise(F.col("problem"))).drop("__have")
    new = checked.where("problem IS NULL").drop("problem").withColumn("scope", F.lit("ATTACHMENT")).withColumn("status", F.lit("UPLOADED")).withColumn("created_at", now).withColumn("updated_at", now).withColumn("expires_at", now + F.make_dt_interval(hours=F.lit(hours)))
    return documents.unionByName(new, allowMissingColumns=True), checked.where("problem IS NOT NULL").select("id", "problem")


def parse_problem(status: Column, key: Column, pages: Column, parser: Column, code: Column) -> Column:
    """Why a parse result cannot be recorded, or null."""
    bad_key = key.isNull() | (F.trim(key) == "") | (key != F.trim(key)) | F.contains(key, F.lit("\\")) | F.rlike(key, F.lit(r"^/|^[A-Za-z]:|(?:^|/)\.{0,2}(?:/|$)"))
    return F.when(bad_key, "parsed_path").when(pages.isNull() | (pages <= 0), "page_count").when((status == "INDEXING") & (F.trim(F.coalesce(parser, F.lit(""))) == ""), "parser").when((status == "PARTIAL") & (F.trim(F.coalesce(code, F.lit(""))) == ""), "error_code")


def parsed(documents: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Parse results (id, page_count, error): good ones of documents that are still unexpired go to INDEXING, errors to FAILED with their code."""
    new = results.select("id", F.col("page_count").alias("__pages"), F.col("error").alias("__error"))
    rows = documents.join(new, "id", "left")
    here = (F.col("status") == "PARSING") & (F.col("__pages").isNotNull() | F.col("__error").isNotNull())
    live = F.col("expires_at").isNull() | (F.col("expires_at") > now)
    status = F.when(here & F.col("__error").isNull() & live, "INDEXING").when(here, "FAILED").otherwise(F.col("status"))
    code = F.when(here & F.col("__error").isNotNull(), F.col("__error")).when(here & ~live, "expired").otherwise(F.col("error_code"))
    return rows.withColumn("error_code", code).withColumn("page_count", F.when(here, F.coalesce("__pages", "page_count")).otherwise(F.col("page_count"))).withColumn("updated_at", F.when(here, now).otherwise(F.col("updated_at"))).withColumn("status", status).select(*documents.columns)


def publish(documents: DataFrame, vectors: DataFrame, chunks: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Vectors of chunks (document_id, ...) whose documents are INDEXING and unexpired replace those documents' old ones; the documents become READY,
    or FAILED if they brought no chunk."""
    documents, vectors, chunks = dealt(documents, "id"), dealt(vectors, "document_id"), dealt(chunks, "document_id")
    open_ = (F.col("status") == "INDEXING") & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    fresh = chunks.join(documents.where(open_).select(F.col("id").alias("document_id")), "document_id", "left_semi")
    kept = vectors.join(fresh.select("document_id").distinct(), "document_id", "left_anti")
    rows = documents.join(chunks.select(F.col("document_id").alias("id")).distinct().withColumn("__m", F.lit(True)), "id", "left").withColumn("__open", F.coalesce(open_, F.lit(False)))
    rows = rows.withColumn("updated_at", F.when(F.col("__open"), now).otherwise(F.col("updated_at")))
    rows = rows.withColumn("status", F.when(F.col("__open"), F.when(F.col("__m"), "READY").otherwise("FAILED")).otherwise(F.col("status")))
    return rows.select(*documents.columns), kept.unionByName(fresh)


def downgrade(documents: DataFrame, vectors: DataFrame, now: Column, code: str = "index_missing") -> DataFrame:
    """Retrievable documents without any vector become FAILED with a code."""
    have = vectors.select(F.col("document_id").alias("id")).distinct()
    bare = documents.where(F.col("status").isin(relational.RETRIEVABLE)).select("id").join(have, "id", "left_anti").withColumn("__bare", F.lit(True))
    rows = documents.join(bare, "id", "left")
    hit = F.coalesce("__bare", F.lit(False))
    return rows.withColumn("error_code", F.when(hit, code).otherwise(F.col("error_code"))).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))).withColumn("status", F.when(hit, "FAILED").otherwise(F.col("status"))).select(*documents.columns)


def remove(documents: DataFrame, vectors: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """To DELETING, vectors gone, to DELETED, row purged: the outcome of these steps in one pass. Rows of states that are not known stay."""
    documents, vectors, named = dealt(documents, "id"), dealt(vectors, "document_id"), dealt(ids.select("id"), "id").distinct()
    going = documents.where(F.col("status").isin(list(relational.TRANSITIONS))).select("id", "status").join(named, "id", "left_semi")  # every known state leads there
    left = vectors.join(going.where("status <> 'DELETED'").select(F.col("id").alias("document_id")), "document_id", "left_anti")
    return documents.join(going.select("id"), "id", "left_anti"), left


def reclaim(documents: DataFrame, vectors: DataFrame, now: Column, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """Remove the first expired documents."""
    return remove(documents, vectors, relational.expired(documents, now, limit).select("id"), now)
