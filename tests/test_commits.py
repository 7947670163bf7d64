from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from brindle.operators import store as S
from brindle.operators.commits import Conflict, Log, Published
from brindle.operators.store import Store


def states(spark, rows):
    return spark.createDataFrame(rows, "id long, status string, n int")


def test_one_writer_gets_a_number(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/t")
    assert log.latest() == (0, None)
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: log.create(1, {"writer": i}), range(24)))
    assert sum(won) == 1 and log.latest()[1]["writer"] == won.index(True)
    assert log.create(2, {"writer": 99}) and log.numbers() == [1, 2] and not log.create(1, {})
    assert [r["writer"] for r in log.prune(1)] == [won.index(True)] and log.latest()[0] == 2


def other_buckets(spark, table, key):
    """A key that lies in another bucket than ``key``."""
    rows = spark.range(100).select(F.col("id"), F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(table.buckets)).alias("b")).collect()
    own = next(r["b"] for r in rows if r["id"] == key)
    return next(r["id"] for r in rows if r["b"] != own)


@pytest.mark.parametrize("same", [False, True])
def test_two_writers_keep_both_changes(spark, tmp_path, same):
    """A second writer commits between the first one's reading and its record: work on other buckets stays as it is, on the same bucket it is done again."""
    table = Store(spark, f"file://{tmp_path}/t", key="id", buckets=8)
    table.rebuild(states(spark, [(i, "NEW", 0) for i in range(100)]))
    mine, theirs = 5, 5 if same else other_buckets(spark, table, 5)
    second, calls, stage = Store(spark, f"file://{tmp_path}/t", key="id", buckets=8), [], table._stage

    def interrupted(rows):
        new = stage(rows)
        calls.append(1)
        if len(calls) == 1:
            second.upsert(states(spark, [(theirs, "THEIRS", 7)]), "id")
        return new

    table._stage = interrupted
    after = table.upsert(states(spark, [(mine, "MINE", 1)]), "id")
    got = {r["id"]: r["status"] for r in after.collect()}
    assert len(got) == 100 and got[mine] == "MINE" and (same or got[theirs] == "THEIRS")
    assert len(calls) == (2 if same else 1) and sorted(map(tuple, table.read().collect())) == sorted(map(tuple, after.collect()))


def test_a_writer_that_never_gets_through_fails(spark, tmp_path):
    table = Store(spark, f"file://{tmp_path}/t", key="id", buckets=2)
    table.rebuild(states(spark, [(1, "NEW", 0)]))
    second, stage = Store(spark, f"file://{tmp_path}/t", key="id", buckets=2), table._stage
    table._stage = lambda rows: (stage(rows), second.rebuild(states(spark, [(1, "THEIRS", 0)])))[0]
    with pytest.raises(Conflict):
        table.upsert(states(spark, [(1, "MINE", 1)]), "id")
    assert [tuple(r) for r in second.read().collect()] == [(1, "THEIRS", 0)] and len(second.log.numbers()) == 1 + S.RETRIES


def test_compare_and_set_among_concurrent_claims(spark, tmp_path):
    """Eight workers claim the same rows at once: each row is won once."""
    root = f"file://{tmp_path}/t"
    Store(spark, root, key="id", buckets=4).rebuild(states(spark, [(i, "UPLOADED" if i != 3 else None, 0) for i in range(6)]))

    def claim(worker):
        rows = [(i, "UPLOADED", "PARSING", worker) for i in (0, 1, 99)] + [(2, "READY", "PARSING", worker), (3, None, "PARSING", worker)]
        table = Store(spark, root, key="id", buckets=4)
        try:
            won = table.compare_and_set(spark.createDataFrame(rows, "id long, expected string, status string, n int"), "status").collect()
        except Conflict:
            return worker, []
        return worker, [r["id"] for r in won if r["won"]]

    with ThreadPoolExecutor(4) as pool:
        won = dict(pool.map(claim, range(1, 5)))
    rows = {r["id"]: (r["status"], r["n"]) for r in Store(spark, root, key="id", buckets=4).read().collect()}
    assert sorted(x for ids in won.values() for x in ids) == [0, 1, 3]
    assert all(rows[i] == ("PARSING", w) for w, ids in won.items() for i in ids) and rows[2] == ("UPLOADED", 0) and len(rows) == 6


def test_lookups_open_few_files(spark, tmp_path):
    table = Store(spark, f"file://{tmp_path}/t", key="id", buckets=64)
    table.rebuild(spark.range(5000).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("v")))
    found = table.lookup([7, 1234, 99999])
    assert sorted(r["v"] for r in found.collect()) == ["v1234", "v7"]
    assert len(found.inputFiles()) <= 3 < 60 < len(table.read().inputFiles()) and table.lookup([]).count() == 0
    import pyarrow.parquet as pq

    one = pq.ParquetFile(found.inputFiles()[0].removeprefix("file://")).metadata.row_group(0)
    assert one.num_rows < 200 and "In(id" in found._jdf.queryExecution().toString()
    names = Store(spark, f"file://{tmp_path}/s", key="name", buckets=4)
    names.rebuild(spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "name string, n int"))
    assert [r["n"] for r in names.lookup(["b", "zz"]).collect()] == [2]


def test_vacuum_keeps_what_is_live(spark, tmp_path):
    table = Store(spark, f"file://{tmp_path}/t", key="id", buckets=4)
    table.rebuild(states(spark, [(i, "a", 0) for i in range(20)]))
    for n in range(4):
        table.upsert(states(spark, [(n, "b", n)]), "id")
    want = sorted(map(tuple, table.read().collect()))
    table.vacuum(1)
    assert table.vacuum(1) == [] and sorted(map(tuple, table.read().collect())) == want and table.log.numbers() == [5]


@pytest.mark.parametrize("step", ["first output", "second output", "record", None])
def test_a_pair_is_published_whole_or_not(spark, tmp_path, step):
    """A crash injected at each step leaves the old pair; readers never see one of each."""
    pair = Published(spark, f"file://{tmp_path}/pair")

    def outputs(n, crash=None):
        def chunks(path):
            spark.range(n).write.parquet(path)
            if crash == "first output":
                raise OSError(crash)

        def manifest(path):
            if crash == "second output":
                raise OSError(crash)
            spark.createDataFrame([(n,)], "n long").write.json(path)

        return {"chunks": chunks, "manifest": manifest}

    def seen():
        at = pair.paths()
        return spark.read.parquet(at["chunks"]).count(), spark.read.json(at["manifest"]).first()["n"]

    assert pair.paths() == {}
    pair.publish(outputs(3))
    if step == "record":
        create, pair.log.create = pair.log.create, lambda *a: (_ for _ in ()).throw(OSError(step))
    if step:
        with pytest.raises(OSError):
            pair.publish(outputs(5, step))
        if step == "record":
            pair.log.create = create
        assert seen() == (3, 3) and len(pair.sweep()) == 1 and seen() == (3, 3)
    else:
        assert pair.publish(outputs(5)) == 2 and seen() == (5, 5)
        assert pair.roll_back() == 3 and seen() == (3, 3)
        pair.publish(outputs(8))
        assert len(pair.sweep(1)) == 2 and seen() == (8, 8)
        with pytest.raises(ValueError):
            pair.roll_back()


def test_backups(spark, tmp_path):
    """A copy that was broken off is none; the newest are kept; a restored one is the table again."""
    table = Store(spark, f"file://{tmp_path}/t", key="id", buckets=4)
    copies = f"file://{tmp_path}/copies"
    table.rebuild(states(spark, [(i, "a", 0) for i in range(9)]))
    (tmp_path / "copies" / ".backup-0000").mkdir(parents=True)
    assert table.backup(copies, "2024-01-01", 2) == ["backup-2024-01-01"]
    table.upsert(states(spark, [(1, "b", 1)]), "id")
    table.backup(copies, "2024-01-03", 2)
    assert table.backup(copies, "2024-01-02", 2) == ["backup-2024-01-03", "backup-2024-01-02"]
    with pytest.raises(ValueError):
        table.backup(copies, "2024-01-02", 2)
    with pytest.raises(ValueError):
        table.backup(copies, "2024-01-04", 0)
    table.delete_where(F.lit(True))
    assert table.count() == 0 and table.restore(copies, "backup-2024-01-03").where("status = 'b'").count() == 1 and table.count() == 9
