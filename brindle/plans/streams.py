"""Queries: streaming operators run over all input at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.store import Store
from brindle.plans.registry import query, table
from brindle.session import shared_folder
from brindle.streaming import lifecycle, traces


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events file as a stream."""
    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    out = traces.drain(traces.hourly(_events(spark, d), "event_type", "value"), shared_folder(spark, "hourly"))
    return out.withColumn("total", F.round("total", 6))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return traces.drain(traces.sessions(_events(spark, d), "user_id"), shared_folder(spark, "sessions"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def stream_dedup_upsert(spark: SparkSession, d: str) -> DataFrame:
    top = shared_folder(spark, "stream")
    store = Store(spark, f"{top}/table", key="user_id")
    rows = _events(spark, d).select("user_id", "event_id", "event_type")
    traces.upsert_stream(rows, store, "user_id", "event_id", f"{top}/log").awaitTermination()
    return store.read()


@query("""WITH e AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS trace_id, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'view' THEN 'start' ELSE 'finish' END AS kind,
      CASE event_type WHEN 'purchase' THEN 'OK' WHEN 'click' THEN 'CANCELLED' ELSE 'ERROR' END AS status FROM events WHERE event_type <> 'signup'),
    s AS (SELECT trace_id, min(ms) AS started FROM e WHERE kind = 'start' GROUP BY trace_id),
    f AS (SELECT s.trace_id, started, min((ms, status)) AS first FROM s LEFT JOIN e ON e.trace_id = s.trace_id AND kind = 'finish' AND ms > started AND ms <= started + 21600000 GROUP BY ALL)
    SELECT trace_id, make_timestamp(started * 1000) AS started, make_timestamp(coalesce(first[1], started + 21600000) * 1000) AS ended, coalesce(first[2], 'EXPIRED') AS status
    FROM f WHERE coalesce(first[1], started + 21600000) <= (SELECT max(ms) FROM e) - 3600000""")
def trace_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """A user's day as a trace: it starts with the first view and ends with the first purchase, click or error within six hours, or expires."""
    top, kind = shared_folder(spark, "lifecycle"), F.col("event_type")
    status = F.when(kind == "purchase", "OK").when(kind == "click", "CANCELLED").otherwise("failed")
    rows = _events(spark, d).where(kind != "signup").select(
        F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("trace_id"), "ts", F.when(kind == "view", "start").otherwise("finish").alias("kind"), status.alias("status")
    )
    decided = lifecycle.decided(rows, "trace_id", ttl="6 hours")
    lifecycle.run(decided, f"{top}/table", f"{top}/log").awaitTermination()
    return spark.read.schema(decided.schema).parquet(f"{top}/table")
