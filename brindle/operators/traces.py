"""Telemetry: request rollups, tool-call rows, reconciliation, ledgers and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text as X

TERMINAL = ["OK", "ERROR", "CANCELLED"]


def terminal_status(status: Column) -> Column:
    """Unknown ends count as errors."""
    return F.when(status.isin(TERMINAL), status).otherwise("ERROR")


def trace_states(events: DataFrame, trace: str = "trace_id", kind: str = "kind", status: str = "status", order: str = "seq") -> DataFrame:
    """One row a started trace: RUNNING, or its first terminal status after the start. An end without a start is ignored."""
    start = F.min(F.when(F.col(kind) == "start", F.col(order)))
    rows = events.withColumn("__start", start.over(Window.partitionBy(trace))).where(F.col("__start").isNotNull())
    end = F.min_by(terminal_status(F.col(status)), F.when((F.col(kind) == "finish") & (F.col(order) > F.col("__start")), F.col(order)))
    return rows.groupBy(trace).agg(F.min("__start").alias("started"), F.coalesce(end, F.lit("RUNNING")).alias("status"))


def rollup(calls: DataFrame, by: str, *, ok: str, cost: str, phase: str, tokens: str | None = None) -> DataFrame:
    """Per request: calls, failures, time in all and by phase (as a map), tokens (null where no call reports any)."""
    per = calls.groupBy(by, phase).agg(F.count("*").alias("n"), F.count_if(~F.col(ok)).alias("bad"), F.sum(cost).alias("ms"), *([F.sum(tokens).alias("tok")] if tokens else []))
    return per.groupBy(by).agg(F.sum("n").alias("calls"), F.sum("bad").alias("failures"), F.sum("ms").alias("total_ms"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(phase, "ms")))).alias("phase_ms"), *([F.sum("tok").alias("tokens")] if tokens else []))


def reconcile(traces: DataFrame, calls: DataFrame, trace: str = "trace_id", stated: str = "tool_calls") -> DataFrame:
    """Traces whose stated number of calls differs from their rows: budget refusals write a row without counting, disabled tools neither."""
    n = calls.groupBy(trace).agg(F.count("*").alias("rows"))
    return traces.join(n, trace, "left").select(trace, F.col(stated).alias("stated"), F.coalesce("rows", F.lit(0)).alias("rows")).where("stated <> rows")


def completeness(traces: DataFrame, **children: DataFrame) -> DataFrame:
    """Each trace's status and its number of rows in every child table."""
    out = traces.select("trace_id", "status")
    for name, rows in children.items():
        out = out.join(rows.groupBy("trace_id").agg(F.count("*").alias(name)), "trace_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def retrieval_summary(hits: DataFrame, by: str, score: str, threshold: float) -> DataFrame:
    """Candidates, hits that pass, greatest and least raw score, and whether any passed."""
    s = F.col(score)
    return hits.groupBy(by).agg(F.count("*").alias("candidate_count"), F.count_if(s >= threshold).alias("hit_count"), F.coalesce(F.max(s), F.lit(0.0)).alias("max_score"), F.coalesce(F.min(s), F.lit(0.0)).alias("min_score"), (F.count_if(s >= threshold) > 0).alias("passed"))


def call_rows(calls: DataFrame, args: str = "args", most: int = 500) -> DataFrame:
    """Tool-call rows: the argument preview is cut first and masked after, so a long one is masked as plain text; a tool's own failure has no code."""
    preview = X.masked_values(F.substring(F.col(args), 1, most))
    code = F.when(F.col("raised"), F.col("error_code"))
    return calls.withColumn("args_preview", preview).withColumn("error_code", code)


def previews(results: Column, most: int = 3) -> Column:
    """The first items of a result list, then of those the titled ones."""
    return F.filter(F.slice(results, 1, most), lambda r: F.length(F.trim(F.coalesce(r["title"], F.lit("")))) > 0)


def latest_user_text(turns: DataFrame, session: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """What a forced call asks: each session's latest user message that is not blank."""
    rows = turns.where((F.col(role) == "user") & (F.length(F.trim(F.col(text))) > 0))
    return rows.groupBy(session).agg(F.max_by(text, order).alias("query"), F.max(order).alias(order))


def available_tools(tools: DataFrame, disabled: list[str], attachments: bool) -> DataFrame:
    """Tools left in the first round: not disabled, and attachment search alone where files are attached."""
    rows = tools.where(~F.col("name").isin(disabled)) if disabled else tools
    return rows.withColumn("forced", F.lit(attachments) & (F.col("name") == "search_attachments"))


def ledger_sources(replies: DataFrame, ledger: DataFrame, run: str, ids: str, rag: bool = True) -> DataFrame:
    """Cited ids of each reply that its ledger knows, once each, in order of citation; notes only with retrieval on."""
    rows = replies.select(run, F.posexplode(F.array_distinct(F.col(ids))).alias("place", "evidence_id"))
    if not rag:
        rows = rows.where(~F.startswith("evidence_id", F.lit("note_")))
    return rows.join(ledger.select(run, "evidence_id").distinct(), [run, "evidence_id"], "left_semi")


def summary_prompt(old: DataFrame, turns: DataFrame, session: str, order: str, line: Column) -> DataFrame:
    """The old summary and the turns in order, one text a session; turns whose line is null are skipped. A session's turns are bounded by the batch
    that is to be summarised."""
    lines = turns.where(line.isNotNull()).groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("new"))
    return lines.join(old.select(session, "summary_text"), session, "left").select(session, F.concat_ws("\n", F.col("summary_text"), F.col("new")).alias("prompt"))
