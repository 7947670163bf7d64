"""Traces as a stateful stream: every started trace ends once, by its first terminal event or by its time to live.

Events (a trace's id, kind ``start`` or ``finish``, status, event time) may come in any order within the watermark. What a trace becomes is decided when the
watermark passes the moment that decides it, so the result does not depend on how events fall into batches: the first end after the first start
and within ``ttl`` of it (OK, ERROR or CANCELLED; others count as ERROR), else EXPIRED at start + ttl. Ends without a start, before it, or after the decision are ignored.
A decided trace is remembered for another ``ttl``, so that repeated events open no second one; ends that wait for their start are forgotten after ``ttl``.
A row is written once for each trace; those still running are read from the state (``running``). Times count in milliseconds.

State lives in RocksDB below the checkpoint, a few values for each open trace, dealt into buckets by a hash of the trace; a restart goes on from there. A bucket's traces are
read, decided and written together, under one timer for the next of them, since each call into the state store and each group costs far more than a row. What a
task holds is the open traces of one bucket: ``buckets`` should grow with their number, and stays what it is for the life of a checkpoint.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from brindle.operators import traces

# The process in which Spark prepares a stateful operator does not see the driver's module path, so the processor travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "started timestamp, ended timestamp, status string"


#: Buckets of traces, and rows of new events that are held before they are merged.
BUCKETS, HELD = 1024, 1 << 17


def _frame(**columns: list) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series(v, dtype=np.int64 if n in ("at", "until") else object) for n, v in columns.items()})


class Traces(StatefulProcessor):
    """The traces of one bucket: ``starts`` (trace, at) of undecided ones, ``ends`` (trace, at, status), and ``done`` (trace, until): decided ones and how long they are remembered."""

    def __init__(self, ttl: int, trace: T.StructField):
        long, name, kind = T.ArrayType(T.LongType()), trace.name, T.ArrayType(trace.dataType)
        fields = [(name, kind), ("__at", long), ("__done", kind), ("__until", long), ("__ended", kind), ("__end", long), ("__status", T.ArrayType(T.StringType())), ("__timer", T.LongType())]
        self.ttl, self.trace, self.schema = ttl, name, T.StructType([T.StructField(n, k) for n, k in fields])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("traces", self.schema)

    def _load(self) -> None:
        a, at, d, until, e, end, status, self.timer = self.state.get() or ([], [], [], [], [], [], [], None)
        self.starts, self.done, self.ends = _frame(trace=a, at=at), _frame(trace=d, until=until), _frame(trace=e, at=end, status=status)

    def _save(self, fired: int | None = None) -> None:
        """Store what is left, and set the bucket's timer to when the next of it is decided or forgotten. Timers go off once the watermark is beyond them."""
        lonely = self._lonely()
        moments = [x.min() for x in (self._found()["ended"], lonely + self.ttl, self.done["until"]) if len(x)]
        if not moments:
            if self.timer is not None and self.timer != fired:
                self.handle.deleteTimer(self.timer)
            self.state.clear()
            return
        timer = int(min(moments)) - 1
        timer += timer == fired  # the one that went off is deleted afterwards
        if timer != self.timer:
            if self.timer is not None and self.timer != fired:
                self.handle.deleteTimer(self.timer)
            self.handle.registerTimer(timer)
        self.state.update((*[c.tolist() for f in (self.starts, self.done, self.ends) for c in (f[n] for n in f.columns)], timer))

    def _lonely(self) -> pd.Series:
        """The last end of each trace that has no start."""
        return self.ends[~self.ends["trace"].isin(self.starts["trace"])].groupby("trace", sort=False)["at"].max()

    def _found(self) -> pd.DataFrame:
        """When and how each started trace ends, as far as its events are known (times in milliseconds)."""
        after = self.ends.rename(columns={"at": "ended"}).merge(self.starts, on="trace")
        after = after[(after["at"] < after["ended"]) & (after["ended"] <= after["at"] + self.ttl)].sort_values("ended").drop_duplicates("trace")
        out = self.starts.merge(after[["trace", "ended", "status"]], on="trace", how="left")
        return out.assign(ended=out["ended"].fillna(out["at"] + self.ttl).astype(np.int64), status=out["status"].fillna("EXPIRED"))

    def _add(self, parts: list[pd.DataFrame]) -> None:
        new = pd.concat(parts)
        new = new[~new["trace"].isin(self.done["trace"])]
        first, last = new[new["kind"] == "start"], new[new["kind"] == "finish"]
        self.starts = pd.concat([self.starts, first[["trace", "at"]]]).sort_values("at").drop_duplicates("trace")
        self.ends = pd.concat([self.ends, last[["trace", "at", "status"]]]).sort_values(["at", "status"]).drop_duplicates(["trace", "at"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        parts = []
        for part in rows:
            parts.append(part[["trace_", "ms", "kind", "status"]].set_axis(["trace", "at", "kind", "status"], axis=1))
            if sum(map(len, parts)) > HELD:
                self._add(parts)
                parts = []
        if parts:
            self._add(parts)
        self._save()
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        now = timerValues.getCurrentWatermarkInMs()
        found = self._found()
        found = found[found["ended"] <= now]
        gone = self._lonely()
        over = set(found["trace"]) | set(gone[gone + self.ttl <= now].index)
        self.starts, self.ends = self.starts[~self.starts["trace"].isin(over)], self.ends[~self.ends["trace"].isin(over)]
        self.done = pd.concat([self.done, found[["trace"]].assign(until=found["ended"] + self.ttl)])
        self.done = self.done[self.done["until"] > now]
        self._save(expiredTimerInfo.getExpiryTimeInMs())
        if len(found):
            yield pd.DataFrame({self.trace: found["trace"], "started": pd.to_datetime(found["at"], unit="ms"), "ended": pd.to_datetime(found["ended"], unit="ms"), "status": found["status"]})

    def close(self) -> None:
        pass


def decided(events: DataFrame, trace: str, *, ts: str = "ts", kind: str = "kind", status: str = "status", ttl: str = "24 hours", late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """The stream of decided traces: the trace's id, started, ended, status."""
    known = traces.terminal_status(F.col(status))
    rows = events.where(F.col(trace).isNotNull() & F.col(ts).isNotNull() & F.col(kind).isin("start", "finish"))
    field = rows.schema[trace]
    rows = rows.select(F.pmod(F.xxhash64(F.col(trace)), F.lit(buckets)).alias("bucket_"), F.col(trace).alias("trace_"), F.col(ts).cast("timestamp").alias("ts"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"), F.col(kind).alias("kind"), F.coalesce(known, F.lit("ERROR")).alias("status"))
    span = int(pd.Timedelta(ttl).total_seconds() * 1000)
    schema = T.StructType([field, *T.StructType.fromDDL(OUTPUT)])
    return rows.withWatermark("ts", late).groupBy("bucket_").transformWithStateInPandas(Traces(span, field), schema, "Append", "EventTime")


def run(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write decided traces to a folder of Parquet files, each once, until the input at hand is used up."""
    spark = rows.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)  # read when the query starts
    try:
        return rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def running(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The traces that are open at the last checkpoint: id and started, from the state itself."""
    state = spark.read.format("statestore").option("stateVarName", "traces").load(checkpoint)
    trace = state.schema["value"].dataType.names[0]
    return state.select(F.explode(F.arrays_zip(F.col("value")[trace], F.col("value.__at"))).alias("x")).select(F.col("x")[trace].alias(trace), F.timestamp_millis(F.col("x")["__at"]).alias("started"))
