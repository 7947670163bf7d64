"""Structured Streaming: trace events to a table of trace states, rolling metrics, sessions, and file changes.

The event log is read in micro-batches; each batch is merged into a keyed table by an idempotent upsert, so a batch that is delivered again changes
nothing. Nothing is dropped when input is ahead: ``maxFilesPerTrigger`` bounds a batch instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.operators import traces
from brindle.operators.commits import Log
from brindle.operators.store import Store


def events(spark: SparkSession, path: str, schema, files_per_batch: int = 16, ts: str | None = "ts") -> DataFrame:
    """A stream over a folder of Parquet files; a time without zone becomes an instant, which watermarks need."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn(ts, F.col(ts).cast("timestamp")) if ts and ts in rows.columns else rows


def upsert_stream(rows: DataFrame, store: Store, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest row of each key in a table; runs until the input at hand is used up."""

    def merge(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        if store.exists():
            old = store.read().join(newest.select(key), key, "left_semi")
            newest = old.unionByName(newest).groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        store.upsert(newest, key)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trace_state_stream(rows: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Trace events (trace_id, kind, status, seq) to one row a trace: RUNNING until its first terminal event after the start; later ends are ignored.
    What a trace needs to be judged again is kept with it: its first start and its earliest end."""

    def merge(batch: DataFrame, number: int) -> None:
        start = F.min(F.when(F.col("kind") == "start", F.col("seq")))
        end = F.when(F.col("kind") == "finish", F.struct(F.col("seq").alias("seq"), traces.terminal_status(F.col("status")).alias("status")))
        new = batch.groupBy("trace_id").agg(start.alias("started"), F.array_sort(F.collect_set(end)).alias("ends"))
        if store.exists():
            new = new.unionByName(store.read().select("trace_id", "started", "ends").join(new.select("trace_id"), "trace_id", "left_semi"))
            new = new.groupBy("trace_id").agg(F.min("started").alias("started"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ends")))).alias("ends"))
        after = F.filter("ends", lambda e: e["seq"] > F.col("started"))
        status = F.when(F.col("started").isNotNull(), F.coalesce(F.get(after, F.lit(0))["status"], F.lit("RUNNING")))
        store.upsert(new.withColumn("status", status), "trace_id")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(rows: DataFrame, by: str, value: str, late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Counts and sums by hour with a watermark (an extension)."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("hour"), by, "n", "total")


def sessions(rows: DataFrame, by: str, gap: str = "30 minutes", late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Activity sessions parted by a gap (an extension)."""
    return rows.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def drain(rows: DataFrame, folder: str) -> DataFrame:
    """Run a streaming aggregate over all input at hand; its last state as a table below ``folder``, where the log is too.

    Each batch writes its state to a folder of its number, which a commit record then names, so readers see one state or the next, whole; a batch
    that is delivered again writes the same folder again."""
    spark = rows.sparkSession
    log = Log(spark, folder)

    def show(batch: DataFrame, number: int) -> None:
        at = f"{folder}/state-{number}"
        batch.write.mode("overwrite").parquet(at)
        log.create(number + 1, {"folder": at})
        path = spark._jvm.org.apache.hadoop.fs.Path
        for old in log.prune(2):
            path(old["folder"]).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(old["folder"]), True)

    q = rows.writeStream.outputMode("complete").foreachBatch(show).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    record = log.latest()[1]
    return spark.read.schema(rows.schema).parquet(record["folder"]) if record else spark.createDataFrame([], rows.schema)


def reclaim(documents: DataFrame, now, act: Callable[[DataFrame], None]) -> int:
    """One round of reclaiming expired attachments; the caller's ``act`` compares and sets their state."""
    from brindle.operators.relational import expired

    due = expired(documents, now, 50)
    n = due.count()
    if n:
        act(due)
    return n


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files added, removed or changed between two listings (path, modificationTime, size)."""
    from brindle.operators.manifest import difference

    mark = lambda rows: rows.select("path", F.concat_ws("/", F.col("modificationTime").cast("string"), F.col("size").cast("string")).alias("mark"))
    return difference(mark(old), mark(new), "path", "mark").where("change <> 'unchanged'")
