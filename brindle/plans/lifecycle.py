"""Queries: writes and lifecycles of sessions, journals and attachments, shard checks, masking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import masking
from brindle.functions import text as X
from brindle.operators import attachments, sessions, shards, traces
from brindle.plans import relations
from brindle.plans.registry import query, table

NOW = F.expr
AT = "TIMESTAMP '1996-06-01 00:00:00'"


@query(f"""WITH a AS {relations.ATTACHMENTS}, ids AS (SELECT id FROM a WHERE id % 7 = 0)
    SELECT status, count(*) AS n FROM a WHERE id NOT IN (SELECT id FROM ids) GROUP BY status""")
def attachment_delete(spark: SparkSession, d: str) -> DataFrame:
    docs = relations.attachments(spark, d)
    vectors = docs.select(F.col("id").alias("document_id"))
    left, _ = attachments.remove(docs, vectors, docs.where("id % 7 = 0"), F.expr(AT))
    return left.groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH a AS {relations.ATTACHMENTS}, e AS (SELECT id FROM a WHERE expires_at <= {AT} ORDER BY expires_at, created_at, id LIMIT 50)
    SELECT count(*) AS documents, count(*) FILTER (WHERE id % 2 = 0) AS vectors FROM a WHERE id NOT IN (SELECT id FROM e)""")
def attachment_reclaim(spark: SparkSession, d: str) -> DataFrame:
    docs = relations.attachments(spark, d)
    left, vectors = attachments.reclaim(docs, docs.where("id % 2 = 0").select(F.col("id").alias("document_id")), F.expr(AT))
    return left.agg(F.count("*").alias("documents")).crossJoin(vectors.agg(F.count("*").alias("vectors")))


@query(f"""WITH a AS {relations.ATTACHMENTS}, p AS (SELECT *, CASE WHEN status <> 'PARSING' OR id % 3 = 2 THEN status WHEN id % 3 = 0 AND expires_at > {AT} THEN 'INDEXING' ELSE 'FAILED' END AS new FROM a)
    SELECT new AS status, count(*) AS n FROM p GROUP BY new""")
def attachment_parse(spark: SparkSession, d: str) -> DataFrame:
    docs = relations.attachments(spark, d).withColumn("page_count", F.lit(None).cast("int")).withColumn("error_code", F.lit(None).cast("string"))
    results = docs.where("id % 3 <> 2").select("id", F.lit(4).alias("page_count"), F.when(F.col("id") % 3 == 1, "parse_failed").alias("error"))
    return attachments.parsed(docs, results, F.expr(AT)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH a AS {relations.ATTACHMENTS} SELECT CASE WHEN status = 'READY' AND id % 2 = 1 THEN 'FAILED' ELSE status END AS status, CASE WHEN status = 'READY' AND id % 2 = 1 THEN 'index_missing' END AS error_code, count(*) AS n FROM a GROUP BY ALL""")
def attachment_downgrade(spark: SparkSession, d: str) -> DataFrame:
    docs = relations.attachments(spark, d).withColumn("error_code", F.lit(None).cast("string"))
    vectors = docs.where("id % 2 = 0").select(F.col("id").alias("document_id"))
    return attachments.downgrade(docs, vectors, F.expr(AT)).groupBy("status", "error_code").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '新会话' ELSE c_name END AS title, c_custkey % 4 = 0 AS touched FROM customer""")
def session_writes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    asked = table(spark, d, "customer").select(k.alias("order"), k.alias("user_id"), F.lit("p").alias("persona_id"), F.lit(None).cast("string").alias("subject"), F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name")).alias("title"))
    rows = sessions.new_session(asked, F.expr(AT), 0)
    first = table(spark, d, "customer").agg(F.min("c_custkey")).first()[0]
    rows = rows.withColumn("id", F.col("id") + first)
    later = F.expr("TIMESTAMP '1997-01-01'")
    rows = sessions.touch(rows, rows.where("id % 4 = 0").select("id"), later)
    return rows.select("id", "title", (F.col("updated_at") > F.col("created_at")).alias("touched"))


@query("""SELECT conv_id AS session_id, CASE WHEN conv_id % 2 = 0 THEN 'new' ELSE 'old' END AS summary_text, conv_id % 2 = 0 AND conv_id % 3 <> 0 AS fresh FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 2 = 0 OR conv_id % 3 = 0""")
def summary_upsert(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    t0, t1 = F.expr(AT), F.expr("TIMESTAMP '1997-01-01'")
    old = ids.where("session_id % 3 = 0").select("session_id", F.lit("old").alias("summary_text"), F.lit(1).cast("long").alias("last_conversation_id"), t0.alias("created_at"), t0.alias("updated_at"))
    new = ids.where("session_id % 2 = 0").select("session_id", F.lit("new").alias("summary_text"), F.lit(2).cast("long").alias("last_conversation_id"))
    return sessions.save_summaries(old, new, t1).select("session_id", "summary_text", (F.col("created_at") == t1).alias("fresh"))


@query("""SELECT 'learning_notes_' || replace(lower(n_name), ' ', '_') AS collection, CASE WHEN n_nationkey % 5 = 1 THEN 'space' WHEN n_nationkey % 5 = 2 THEN 'manifest' ELSE 'embedding_model' END AS problem FROM nation WHERE n_nationkey % 5 IN (1, 2, 3)""")
def shard_consistency(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey") % 5
    name = F.concat(F.lit("learning_notes_"), F.regexp_replace(F.lower("n_name"), " ", "_"))
    rows = table(spark, d, "nation").select(name.alias("collection"), F.when(k == 1, "l2").otherwise("cosine").alias("space"), F.when(k == 2, "other").when(k == 3, name).alias("manifest_collection"), F.when(k == 3, F.concat(F.lit("m"), (F.col("n_nationkey") % 2).cast("string"))).alias("embedding_model"))
    return shards.problems(rows)


@query("""SELECT event_id, '{"k": ' || json_extract_string(props, '$.k') || ', "in": [{"api_key": "[REDACTED]"}]}' AS preview FROM events""")
def masked_previews(spark: SparkSession, d: str) -> DataFrame:
    args = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "in": [{"api_key": {"x": 1}}]}'))
    return table(spark, d, "events").select("event_id", masking.args_preview(args).alias("preview"))


@query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Bearer <redacted> failed' WHEN 1 THEN 'timeout' ELSE 'remote call failed (details redacted)' END AS shown FROM nation WHERE n_nationkey % 3 = 1 UNION ALL SELECT n_nationkey, 'remote call failed (details redacted)' FROM nation WHERE n_nationkey % 3 <> 1""")
def redacted_errors(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    said = F.when(k == 0, "Bearer abc.def failed").when(k == 1, "timeout").otherwise("bad password: hunter2")
    return table(spark, d, "nation").select("n_nationkey", X.redact_error(said).alias("shown"))


@query("""SELECT user_id AS trace_id, 'OK' AS status, count(*) FILTER (WHERE event_type = 'click') AS tool_calls, count(*) FILTER (WHERE event_type = 'view') AS llm_calls FROM events GROUP BY user_id""")
def trace_completeness(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("user_id", "trace_id")
    roots = e.select("trace_id").distinct().withColumn("status", F.lit("OK"))
    return traces.completeness(roots, tool_calls=e.where("event_type = 'click'"), llm_calls=e.where("event_type = 'view'"))
