"""Queries: evaluation metrics, percentiles, histograms, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import evaluate
from brindle.plans.registry import query, table
from brindle.plans.retrieval import MANY_SQL, many_hits

THRESHOLDS = [0.0, 0.2, 0.3]


def _results(spark: SparkSession, d: str, thresholds: list[float]) -> DataFrame:
    """Cases: every vector whose id is divisible by 50; those divisible by 100 expect a neighbour of their label, the others none."""
    hits = many_hits(spark, d).select(F.col("query_id").alias("case_id"), "vec_id", (F.col("label") == F.col("query_label")).alias("matched"), F.round("similarity", 9).alias("similarity"))
    cases = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("case_id"), (F.col("vec_id") % 100 == 0).alias("positive"), (F.col("label") % 2).alias("group"))
    return evaluate.case_results(cases, hits, group="group", ties=["vec_id"], thresholds=thresholds)


def _sql(by: str, thresholds: list[float]) -> str:
    grid = ", ".join(f"({t}::DOUBLE)" for t in thresholds)
    return f"""WITH m AS (SELECT *, round(s, 9) AS sim FROM ({MANY_SQL}) WHERE rank <= 4 AND vec_id <> query_id),
    h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS r FROM m), t(threshold) AS (VALUES {grid}),
    c AS (SELECT vec_id AS case_id, vec_id % 100 = 0 AS positive, label % 2 AS "group" FROM embeddings WHERE vec_id % 50 = 0),
    f AS (SELECT query_id AS case_id, threshold, min(CASE WHEN label = query_label THEN r END) AS rank, count(*) AS passed FROM h, t WHERE sim >= threshold GROUP BY ALL),
    e AS (SELECT c.*, t.threshold, f.rank, coalesce(f.passed, 0) AS passed FROM c CROSS JOIN t LEFT JOIN f ON f.case_id = c.case_id AND f.threshold = t.threshold),
    g AS (SELECT {by}{', ' if by else ''}count(*) FILTER (WHERE positive) AS positives, count(*) FILTER (WHERE NOT positive) AS negatives, count(*) FILTER (WHERE positive AND rank IS NOT NULL) AS hits, count(*) FILTER (WHERE NOT positive AND passed = 0) AS quiet, coalesce(sum(CASE WHEN positive THEN 1.0::DOUBLE / rank END), 0) AS rr FROM e {'GROUP BY ' + by if by else ''})
    SELECT {by}{', ' if by else ''}positives, negatives, hits, round(CASE WHEN positives = 0 THEN 0 ELSE hits / positives END, 9) AS recall, round(CASE WHEN positives = 0 THEN 0 ELSE rr / positives END, 9) AS mrr, round(CASE WHEN negatives = 0 THEN 0 ELSE quiet / negatives END, 9) AS negative_accuracy, round(CASE WHEN positives + negatives = 0 THEN 0 ELSE (hits + quiet) / (positives + negatives) END, 9) AS accuracy FROM g"""


def _shown(rows: DataFrame) -> DataFrame:
    rates = ("recall", "mrr", "negative_accuracy", "accuracy")
    return rows.select(*[F.round(c, 9).alias(c) if c in rates else F.col(c) for c in rows.columns])


@query(_sql("", [0.3]))
def recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    return _shown(evaluate.metrics(_results(spark, d, [0.3])))


@query(_sql('"group"', [0.3]))
def recall_by_group(spark: SparkSession, d: str) -> DataFrame:
    return _shown(evaluate.metrics(_results(spark, d, [0.3]), "group"))


@query(_sql("threshold", THRESHOLDS))
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _shown(evaluate.metrics(_results(spark, d, THRESHOLDS), "threshold"))


@query(f"""WITH m AS ({MANY_SQL}), b AS (SELECT query_label, label, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS n FROM m WHERE vec_id <> query_id)
    SELECT query_label::VARCHAR AS expected, label::VARCHAR AS chosen, count(*) AS n FROM b WHERE n = 1 GROUP BY ALL""")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    hits = many_hits(spark, d)
    first = hits.groupBy("query_id", "query_label").agg(F.min_by("label", F.struct((-F.col("similarity")).alias("s"), "vec_id")).alias("label"))
    cases = first.select(F.array(F.col("query_label").cast("string")).alias("expected"), F.array(F.col("label").cast("string")).alias("chosen"))
    return evaluate.confusion(cases, "expected", "chosen")


@query("SELECT list_sort(list_distinct([event_type, 'error'])) = list_sort(list_distinct([CASE WHEN event_id % 3 = 0 THEN 'error' ELSE event_type END, 'error'])) AS correct, count(*) AS n FROM events GROUP BY 1")
def routing_accuracy(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    cases = table(spark, d, "events").select(F.array(t, F.lit("error")).alias("e"), F.array(F.lit("error"), F.when(F.col("event_id") % 3 == 0, "error").otherwise(t)).alias("c"))
    return evaluate.routing(cases, "e", "c").groupBy("correct").agg(F.count("*").alias("n"))


_NTH = "(SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)"


@query(f"""SELECT event_type, max(CASE WHEN r = greatest(1, floor(n * 0.95)) THEN v END) AS p95_floor, max(CASE WHEN r = greatest(1, ceil(n * 0.95)) THEN v END) AS p95_ceil, max(CASE WHEN r = round_even((n - 1) * 0.95, 0)::BIGINT + 1 THEN v END) AS p95_round, round(median(v), 9) AS p50 FROM {_NTH} GROUP BY event_type""")
def latency_p50_p95(spark: SparkSession, d: str) -> DataFrame:
    """Three conventions for the 95th percentile, and the interpolated median."""
    e, n = table(spark, d, "events"), F.col("n")
    places = {"p95_floor": evaluate.p95_floor(n), "p95_ceil": evaluate.p95_ceil(n), "p95_round": evaluate.p_round(n, 0.95)}
    out = evaluate.interpolated(e, "value", [0.5], "event_type", more=places).withColumn("p50", F.round("p50", 9))
    return out


@query(f"""SELECT event_type, count(*) AS calls, count(*) FILTER (WHERE bad) AS failures, round(max(CASE WHEN r = round_even((n - 1) * 0.5, 0)::BIGINT + 1 THEN v END), 3) AS p50, round(max(CASE WHEN r = round_even((n - 1) * 0.95, 0)::BIGINT + 1 THEN v END), 3) AS p95
    FROM (SELECT event_type, value AS v, event_id % 11 = 0 AS bad, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type""")
def tool_metrics(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").withColumn("ok", F.col("event_id") % 11 != 0)
    return evaluate.tool_metrics(calls, "event_type", latency="value")


@query("""WITH l AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000)
    SELECT event_type, count(*) AS calls, count(*) FILTER (WHERE bad) AS failures, round(max(CASE WHEN r = round_even((n - 1) * 0.5, 0)::BIGINT + 1 THEN v END), 3) AS p50, round(max(CASE WHEN r = round_even((n - 1) * 0.95, 0)::BIGINT + 1 THEN v END), 3) AS p95
    FROM (SELECT event_type, value AS v, event_id % 11 = 0 AS bad, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM l) GROUP BY event_type""")
def tool_metrics_last_n(spark: SparkSession, d: str) -> DataFrame:
    from brindle.operators.windows import last_rows

    calls = last_rows(table(spark, d, "events"), "ts", "event_id").withColumn("ok", F.col("event_id") % 11 != 0)
    return evaluate.tool_metrics(calls, "event_type", latency="value")


EDGES = [(0, 128), (128, 256), (256, 512), (512, 1024), (1024, 2048), (2048, 4096), (4096, 8192), (8192, 16384), (16384, None)]


@query("""SELECT low, count(*) AS n FROM documents, (VALUES (0, 128), (128, 256), (256, 512), (512, 1024), (1024, 2048), (2048, 4096), (4096, 8192), (8192, 16384), (16384, NULL)) b(low, high) WHERE n_chars >= low AND (high IS NULL OR n_chars <= high) GROUP BY low""")
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.histogram(table(spark, d, "documents"), "n_chars", EDGES).select("low", "n")


@query("""SELECT lang, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.95), 6) AS p95, count(*) FILTER (WHERE n_chars > 512) AS over_512 FROM documents GROUP BY lang""")
def length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    p = evaluate.interpolated(docs, "n_chars", [0.5, 0.9, 0.95], "lang").select("lang", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p95")])
    return p.join(docs.groupBy("lang").agg(F.count_if(F.col("n_chars") > 512).alias("over_512")), "lang")


@query("""WITH s AS (SELECT l_orderkey, l_partkey AS name, greatest(1, least(5, l_linenumber))::INT AS imp, greatest(0, least(5, (l_quantity / 10)::INT)) AS lvl FROM lineitem),
    a AS (SELECT l_orderkey, round_even(sum(imp * lvl) * 100.0 / sum(imp * 5), 0)::INT AS score, list(name ORDER BY lvl DESC, imp DESC, name) FILTER (WHERE lvl >= 4) AS s, list(name ORDER BY (5 - lvl) * imp DESC, imp DESC, name) FILTER (WHERE imp >= 4 AND lvl <= 2) AS g FROM s GROUP BY l_orderkey)
    SELECT l_orderkey, score, CASE WHEN score >= 85 THEN 'strong' WHEN score >= 70 THEN 'good' WHEN score >= 40 THEN 'partial' ELSE 'weak' END AS band, coalesce(array_to_string(s[1:3], ','), '') AS strengths, coalesce(array_to_string(g[1:3], ','), '') AS gaps FROM a""")
def skill_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.bround(F.col("l_quantity") / 10).cast("int").alias("lvl"))
    return evaluate.skill_fit(rows, "l_orderkey", "l_linenumber", "lvl", "l_partkey")


@query("""SELECT mode, count(*) AS records, count(*) FILTER (WHERE quality IS NOT NULL AND toxic IS NOT NULL) AS scored, round(avg(quality + toxic), 9) AS mean_total, round(avg(quality), 9) AS mean_quality, round(avg(toxic), 9) AS mean_toxic
    FROM (SELECT CASE WHEN d.doc_id % 2 = 0 THEN 'tool_only' ELSE 'seed' END AS mode, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY mode""")
def manual_score_summary(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.manual_scores(_records(spark, d), "mode", ["quality", "toxic"])
    return out.select("mode", "records", "scored", *[F.round(c, 9).alias(c) for c in ("mean_total", "mean_quality", "mean_toxic")])


def _records(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return docs.withColumn("mode", F.when(F.col("doc_id") % 2 == 0, "tool_only").otherwise("seed"))


@query("""WITH m AS (SELECT mode, avg(quality + toxic) AS t FROM (SELECT CASE WHEN d.doc_id % 2 = 0 THEN 'tool_only' ELSE 'seed' END AS mode, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY mode)
    SELECT CASE WHEN count(t) < 2 THEN NULL WHEN min(t) = max(t) THEN 'tie' ELSE arg_max(mode, t) END AS winner FROM m""")
def manual_score_winner(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.winner(evaluate.manual_scores(_records(spark, d), "mode", ["quality", "toxic"]), "mode")


@query("""SELECT count(*) AS cases, count(*) FILTER (WHERE contains(text, 'the ') OR contains(text, 'der ')) AS covered, round(avg(length(text)), 6) AS mean_chars, max(length(text)) AS max_chars FROM documents""")
def seed_coverage(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "documents").withColumn("sources", F.array(F.lit("the "), F.lit("der ")))
    out = evaluate.seed_coverage(cases, "text", "sources")
    return out.select("cases", "covered", F.round("mean_chars", 6).alias("mean_chars"), F.col("max_chars").cast("long").alias("max_chars"))
