from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from brindle.streaming import lifecycle

SCHEMA = "trace_id string, kind string, status string, ts timestamp"
AT = datetime(2024, 1, 1)


def put(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def go(spark, top, **options):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
    lifecycle.run(lifecycle.decided(rows, "trace_id", **options), f"{top}/out", f"{top}/log").awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(f"{top}/out").collect()), {r["trace_id"] for r in lifecycle.running(spark, f"{top}/log").collect()}


def test_decisions_late_ends_and_restarts(spark, tmp_path):
    top, at = f"file://{tmp_path}", lambda m: AT + timedelta(minutes=m)
    put(spark, [("a", "start", None, at(0)), ("b", "finish", "OK", at(10)), ("c", "start", None, at(0)), ("d", "finish", "OK", at(3)), (None, "start", None, at(1)), ("e", "other", "OK", at(1))], f"{top}/in")
    assert go(spark, top) == ([], {"a", "c"})
    put(spark, [("a", "finish", "weird", at(20)), ("a", "finish", "OK", at(30)), ("b", "start", None, at(5)), ("c", "start", None, at(2)), ("z", "start", None, at(3000))], f"{top}/in")
    done = sorted([("a", at(0), at(20), "ERROR"), ("b", at(5), at(10), "OK"), ("c", at(0), at(1440), "EXPIRED")])
    assert go(spark, top) == (done, {"z"})
    assert go(spark, top) == (done, {"z"})
    # an end after the expiry is late; a trace that was forgotten may start again
    put(spark, [("c", "finish", "OK", at(1450)), ("a", "start", None, at(2990)), ("z", "finish", "CANCELLED", at(3010)), ("y", "start", None, at(9000))], f"{top}/in")
    assert go(spark, top) == (sorted([*done, ("z", at(3000), at(3010), "CANCELLED"), ("a", at(2990), at(2990 + 1440), "EXPIRED")]), {"y"})


@pytest.mark.parametrize("files", [1, 5])
def test_batches_do_not_change_the_outcome(spark, tmp_path, files):
    """Events out of order within the watermark, in one batch or five: the outcome of the plain rule over all of them."""
    rng, top = random.Random(4), f"file://{tmp_path}"
    rows = [(f"t{rng.randrange(25)}", rng.choice(["start", "finish"]), rng.choice(["OK", "ERROR", "x", None]), AT + timedelta(minutes=i + rng.randint(0, 25))) for i in range(150)]
    rows.append(("end", "start", None, AT + timedelta(days=3)))
    size = -(-len(rows) // files)
    for lo in range(0, len(rows), size):
        put(spark, rows[lo : lo + size], f"{top}/in")
    got, _ = go(spark, top, ttl="40 minutes", late="30 minutes")
    want = {}
    for trace in {r[0] for r in rows} - {"end"}:
        starts = [t for x, k, _, t in rows if x == trace and k == "start"]
        if starts:
            ends = {}
            for x, k, s, t in rows:
                if x == trace and k == "finish":
                    ends.setdefault(t, set()).add(s if s in ("OK", "ERROR", "CANCELLED") else "ERROR")
            after = sorted(t for t in ends if min(starts) < t <= min(starts) + timedelta(minutes=40))
            want[trace] = (min(starts), after[0], min(ends[after[0]])) if after else (min(starts), min(starts) + timedelta(minutes=40), "EXPIRED")
    first = {}
    for trace, *rest in got:  # a trace may open again once it was forgotten
        first[trace] = min(first.get(trace, tuple(rest)), tuple(rest))
    assert first == want


def test_drained_states_are_shown_whole(spark, tmp_path):
    """Several batches leave the last state; older ones go, and a second run without input changes nothing."""
    from pyspark.sql import functions as F

    from brindle.operators.commits import Log
    from brindle.streaming import traces

    for n in range(4):
        put(spark, [(f"t{i % 3}", "start", None, AT) for i in range(n + 1)], f"file://{tmp_path}/in")
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in").groupBy("trace_id").agg(F.count("*").alias("n"))
    for _ in range(2):
        assert {tuple(r) for r in traces.drain(rows, f"file://{tmp_path}/out").collect()} == {("t0", 5), ("t1", 3), ("t2", 2)}
    assert len(Log(spark, f"file://{tmp_path}/out").numbers()) == 2 and len(list((tmp_path / "out").glob("state-*"))) == 2


def test_many_traces_are_a_few_groups_of_state(spark, tmp_path):
    """Traces share buckets, so that calls into the state store do not grow with their number; one decided at the watermark itself is out."""
    top, at = f"file://{tmp_path}", lambda m: AT + timedelta(minutes=m)
    put(spark, [(f"t{i}", "start", None, at(i % 50)) for i in range(500)] + [(f"t{i}", "finish", "OK", at(100)) for i in range(0, 500, 2)], f"{top}/in")
    put(spark, [("x", "finish", "OK", at(160))], f"{top}/in")
    done, open_ = go(spark, top, buckets=4)
    assert done == sorted((f"t{i}", at(i % 50), at(100), "OK") for i in range(0, 500, 2)) and open_ == {f"t{i}" for i in range(1, 500, 2)}
    assert spark.read.format("statestore").option("stateVarName", "traces").load(f"{top}/log").count() <= 4
    put(spark, [("x", "start", None, at(9000)), ("t0", "start", None, at(9000))], f"{top}/in")
    done, open_ = go(spark, top, buckets=4)
    assert len(done) == 500 and sum(r[3] == "EXPIRED" for r in done) == 250 and open_ == {"x"}  # t0 is remembered until the watermark passes


def test_ids_of_another_kind(spark, tmp_path):
    from pyspark.sql import functions as F

    put(spark, [("7", "start", None, AT), ("8", "start", None, AT + timedelta(days=9))], f"file://{tmp_path}/in")
    rows = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in").withColumn("kind", F.col("kind")).withColumn("trace_id", F.col("trace_id").cast("long"))
    lifecycle.run(lifecycle.decided(rows, "trace_id"), f"file://{tmp_path}/out", f"file://{tmp_path}/log").awaitTermination()
    assert [r["trace_id"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == [7]
    assert [r["trace_id"] for r in lifecycle.running(spark, f"file://{tmp_path}/log").collect()] == [8]
