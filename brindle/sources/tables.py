"""Schemas of the business and trace tables, and reading them with additive schema changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _I, _D, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SCHEMAS = {
    "chat_sessions": _schema(id=_L, user_id=_S, title=_S, persona_id=_S, subject=_S, created_at=_TS, updated_at=_TS),
    "conversations": _schema(id=_L, session_id=_L, user_id=_S, message=_S, reply_json=_S, created_at=_TS),
    "session_summaries": _schema(id=_L, session_id=_L, summary_text=_S, last_conversation_id=_L, created_at=_TS, updated_at=_TS),
    "journal_entries": _schema(id=_L, user_id=_S, session_id=_L, entry_date=T.DateType(), title=_S, content=_S, tags=_S, created_at=_TS, updated_at=_TS),
    "documents": _schema(id=_S, scope=_S, status=_S, user_id=_S, session_id=_L, original_filename=_S, mime_type=_S, size_bytes=_L, content_sha256=_S, page_count=_I, error_code=_S, expires_at=_TS, created_at=_TS, updated_at=_TS),
    "agent_traces": _schema(trace_id=_S, status=_S, rounds=_I, tool_calls=_I, total_ms=_D, prompt_tokens=_L, completion_tokens=_L, created_at=_TS),
    "retrieval_events": _schema(trace_id=_S, collection=_S, cost_ms=_D, top_k=_I, max_score=_D, min_score=_D, passed=_I, threshold=_D, created_at=_TS),
    "llm_calls": _schema(trace_id=_S, round_number=_I, call_type=_S, prompt_tokens=_L, completion_tokens=_L, cost_ms=_D, created_at=_TS),
    "tool_calls": _schema(trace_id=_S, tool_name=_S, channel=_S, forced=_I, ok=_I, error_code=_S, cost_ms=_D, args_preview=_S, created_at=_TS),
}


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The table with its schema; columns that old files lack are null."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def append(rows: DataFrame, name: str, path: str) -> None:
    """Append rows, with columns they lack as null and others left out."""
    known = SCHEMAS[name]
    have = set(rows.columns)
    rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in known]).write.mode("append").parquet(path)


def document_problems(rows: DataFrame) -> DataFrame:
    """Document rows whose shape breaks a rule: attachments have an owner, a session and an expiry, others none; failures a code; sizes are not negative."""
    attached = F.col("scope") == "ATTACHMENT"
    shape = F.when(attached, F.col("user_id").isNull() | F.col("session_id").isNull() | F.col("expires_at").isNull()).when(F.col("scope") == "PRIVATE", F.col("user_id").isNull() | F.col("session_id").isNotNull()).otherwise(F.col("user_id").isNotNull() | F.col("session_id").isNotNull())
    problem = F.when(~F.col("scope").isin("INTERNAL", "PRIVATE", "ATTACHMENT"), "scope").when(shape, "scope_shape")
    problem = problem.when(~F.col("status").isin("UPLOADED", "PARSING", "INDEXING", "READY", "PARTIAL", "FAILED", "DELETING", "DELETED"), "status")
    problem = problem.when((F.col("status") == "FAILED") & F.col("error_code").isNull(), "error_code").when((F.col("status") == "PARTIAL") & F.col("error_code").isNull(), "error_code")
    problem = problem.when(F.col("size_bytes") < 0, "size").when(F.col("page_count") <= 0, "page_count")
    return rows.select("id", problem.alias("problem")).where("problem IS NOT NULL")


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    return rows.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")
