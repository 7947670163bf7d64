"""Queries: traces, budgets, ledgers and status histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.operators import relational, traces, windows
from brindle.plans.registry import query, table


@query("""SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS failures, round(sum(value), 6) AS total_ms, round(coalesce(sum(value) FILTER (WHERE event_type = 'click'), -1), 6) AS click_ms, sum(try_cast(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS tokens FROM events GROUP BY user_id""")
def trace_rollup(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").withColumn("ok", F.col("event_type") != "error").withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))
    out = traces.rollup(calls, "user_id", ok="ok", cost="value", phase="event_type", tokens="k")
    return out.select("user_id", "calls", "failures", F.round("total_ms", 6).alias("total_ms"), F.round(F.coalesce(F.element_at("phase_ms", F.lit("click")), F.lit(-1.0)), 6).alias("click_ms"), "tokens")


@query("""SELECT user_id, event_id, event_type, n AS call, n <= 2 AS allowed FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)""")
def call_budget(spark: SparkSession, d: str) -> DataFrame:
    out = windows.within_budget(table(spark, d, "events"), "user_id", "event_type", "event_id")
    return out.select("user_id", "event_id", "event_type", F.col("call").cast("long").alias("call"), "allowed")


@query("""SELECT user_id, event_id, f AS failures FROM (SELECT *, sum(bad) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS f FROM (SELECT *, (event_type = 'error')::INT AS bad FROM events)) WHERE f - bad < 2""")
def failure_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return windows.cut_off(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "error").select("user_id", "event_id", "failures")


@query("""WITH e AS (SELECT user_id, event_id, event_id // 200 AS turn, (event_type = 'error')::INT AS bad FROM events),
    f AS (SELECT *, sum(bad) OVER (PARTITION BY user_id ORDER BY turn)::BIGINT AS failures, coalesce(sum(bad) OVER (PARTITION BY user_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
    SELECT user_id, event_id, turn, failures FROM f WHERE before < 2""")
def failure_cutoff_rounds(spark: SparkSession, d: str) -> DataFrame:
    """A round is a stretch of 200 event ids."""
    e = table(spark, d, "events").withColumn("turn", F.floor(F.col("event_id") / 200))
    return windows.cut_off_rounds(e, "user_id", "turn", F.col("event_type") == "error").select("user_id", "event_id", "turn", "failures")


@query("""SELECT user_id, stated, rows FROM (SELECT user_id, count(*) FILTER (WHERE event_type <> 'view') AS stated, count(*) AS rows FROM events GROUP BY user_id) WHERE stated <> rows""")
def trace_reconcile(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    stated = e.groupBy(F.col("user_id").alias("trace_id")).agg(F.count_if(F.col("event_type") != "view").alias("tool_calls"))
    return traces.reconcile(stated, e.withColumnRenamed("user_id", "trace_id")).select(F.col("trace_id").alias("user_id"), "stated", "rows")


@query("""WITH s AS (SELECT user_id, min(event_id) FILTER (WHERE event_type = 'click') AS started FROM events GROUP BY user_id),
    e AS (SELECT user_id, arg_min(CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END, event_id) AS status FROM events JOIN s USING (user_id) WHERE event_type IN ('error', 'purchase') AND event_id > started GROUP BY user_id)
    SELECT user_id, started, coalesce(status, 'RUNNING') AS status FROM s LEFT JOIN e USING (user_id) WHERE started IS NOT NULL""")
def trace_states(spark: SparkSession, d: str) -> DataFrame:
    """A click starts a user's trace, a purchase or an error ends it."""
    t = F.col("event_type")
    e = table(spark, d, "events").select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("seq"), F.when(t == "click", "start").when(t.isin("error", "purchase"), "finish").otherwise("other").alias("kind"), F.when(t == "purchase", "OK").otherwise("boom").alias("status"))
    return traces.trace_states(e).select(F.col("trace_id").alias("user_id"), "started", "status")


@query("""SELECT user_id, event_id, event_type, before FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    WHERE before IS NOT NULL AND NOT ((before = 'view' AND event_type IN ('click', 'view')) OR (before = 'click' AND event_type IN ('purchase', 'view')))""")
def status_transitions(spark: SparkSession, d: str) -> DataFrame:
    allowed = {"view": ["click", "view"], "click": ["purchase", "view"]}
    return relational.transition_problems(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"], allowed).select("user_id", "event_id", "event_type", "before")


@query("""SELECT event_type, count(*) AS candidate_count, count(*) FILTER (WHERE value >= 50) AS hit_count, max(value) AS max_score, min(value) AS min_score, count(*) FILTER (WHERE value >= 50) > 0 AS passed FROM events GROUP BY event_type""")
def retrieval_events(spark: SparkSession, d: str) -> DataFrame:
    return traces.retrieval_summary(table(spark, d, "events"), "event_type", "value", 50)


@query("""WITH f AS (SELECT doc_id, source, lang, min(doc_id) OVER (PARTITION BY source, lang) AS first FROM documents)
    SELECT doc_id, source, 'note_' || dense_rank() OVER (PARTITION BY source ORDER BY first) AS evidence_id FROM f""")
def evidence_ledger(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", F.lit("note").alias("kind"))
    return windows.evidence_ids(rows, "source", "kind", "lang", "doc_id").select("doc_id", "source", "evidence_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'see [note_1] and [link]' ELSE 'see  and [link]' END AS shown FROM documents""")
def citation_filter(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("doc_id") % 2 == 0, "see [note_1] and https://a.example/x").otherwise("see [web_9] and http://b.example")
    return table(spark, d, "documents").select("doc_id", X.cited_only(said, F.array(F.lit("note_1"))).alias("shown"))


@query("""WITH c AS (SELECT conv_id, list_distinct(list(role)) AS roles FROM conversations GROUP BY conv_id) SELECT conv_id, 'note_' || k AS evidence_id FROM (SELECT conv_id, unnest([1, 2, 3]) AS k FROM c) WHERE k <= 1 + conv_id % 3""")
def ledger_sources(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "conversations").select("conv_id").distinct()
    replies = ids.withColumn("ids", F.array(*[F.lit(f"note_{i}") for i in (1, 2, 1, 3)]))
    known = ids.select("conv_id", F.explode(F.sequence(F.lit(1), (F.lit(1) + F.col("conv_id") % 3).cast("int"))).alias("k")).select("conv_id", F.concat(F.lit("note_"), F.col("k").cast("string")).alias("evidence_id"))
    return traces.ledger_sources(replies, known, "conv_id", "ids").select("conv_id", "evidence_id")


@query("""SELECT conv_id, arg_max(text, turn) AS query, max(turn) AS turn FROM conversations WHERE role = 'user' AND length(trim(text)) > 0 GROUP BY conv_id""")
def latest_user_message(spark: SparkSession, d: str) -> DataFrame:
    return traces.latest_user_text(table(spark, d, "conversations"), "conv_id", "turn")


@query("""SELECT conv_id, len(list_filter(list(CASE WHEN turn % 2 = 0 THEN role ELSE '' END ORDER BY turn)[1:3], lambda r: r <> '')) AS shown FROM conversations GROUP BY conv_id""")
def preview_top3(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("")
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", title.alias("title")))).alias("r"))
    return rows.select("conv_id", F.size(traces.previews(F.col("r"))).cast("long").alias("shown"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'boom' END AS error_code, substr('{"k":' || json_extract_string(props, '$.k') || ',"api_key":[REDACTED]}', 1, 500) AS args_preview FROM events""")
def tool_call_rows(spark: SparkSession, d: str) -> DataFrame:
    args = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"api_key":"abc'), F.col("event_id").cast("string"), F.lit('"}'))
    calls = table(spark, d, "events").select("event_id", args.alias("args"), (F.col("event_type") == "error").alias("raised"), F.lit("boom").alias("error_code"))
    return traces.call_rows(calls).select("event_id", "error_code", "args_preview")


@query("""SELECT conv_id, string_agg(role || ': ' || length(text), chr(10) ORDER BY turn) AS prompt FROM conversations WHERE turn % 3 <> 2 GROUP BY conv_id""")
def summary_prompt(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    line = F.when(F.col("turn") % 3 != 2, F.concat_ws(": ", "role", F.length("text").cast("string")))
    old = turns.limit(0).select("conv_id", F.lit("").alias("summary_text"))
    return traces.summary_prompt(old, turns, "conv_id", "turn", line)


@query("""SELECT h AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT date_trunc('hour', ts) AS h, * FROM events) GROUP BY ALL""")
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
