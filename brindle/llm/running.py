"""Positions, running sums and chained keys over a table in sorted order, by tasks that each see one range.

Ranges are sorted apart, every task adds up its own rows in a stream, the totals of the ranges (one row each) are added up on the
driver, and each row takes the total of the ranges before its own. So no key, however frequent, has to fit one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.shared import Scratch, with_fields

#: Odd bases of the two polynomial keys (a fixed choice; any odd numbers do), and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSE = tuple(pow(b, -1, 1 << 64) for b in BASES)
_WORD = (1 << 64) - 1


def sorted_ranges(rows: DataFrame, order: list[str], parts: int) -> DataFrame:
    """Rows in ``parts`` sorted ranges, a task for each; rows equal in all of ``order`` may lie in several ranges."""
    spread = rows.withColumn("__spread", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in [*order, "__spread"]]
    return spread.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("__spread")


def running(scratch: Scratch, rows: DataFrame, order: list[str], parts: int, sums: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``at`` (place in the order, from 0) and, for each column of ``sums`` (longs, not negative), ``<column>_sum`` up to and with the row."""
    more = ["at", *[f"{c}_sum" for c in sums]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, done = TaskContext.get().partitionId(), np.zeros(1 + len(sums), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            steps = [np.ones(b.num_rows, np.int64), *[b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in sums]]
            totals = [np.cumsum(s) + d for s, d in zip(steps, done, strict=True)]
            done = np.array([t[-1] for t in totals])
            totals[0] = totals[0] - 1
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, totals), pa.array(np.full(b.num_rows, pid, np.int64))], [*b.schema.names, *more, "range"])

    schema = with_fields(rows.schema, *[T.StructField(c, T.LongType()) for c in [*more, "range"]])
    table = scratch.put(sorted_ranges(rows, order, parts).mapInArrow(run, schema))
    got = sorted(table.groupBy("range").agg(*[F.max(c).alias(c) for c in more]).collect(), key=lambda r: r["range"])  # a row for each range
    before, total = [], [0] * len(more)
    for r in got:
        before.append((r["range"], *total))
        total = [t + r[c] + (c == "at") for t, c in zip(total, more, strict=True)]
    offsets = rows.sparkSession.createDataFrame(before, T.StructType([T.StructField(c, T.LongType()) for c in ["range", *[f"before_{c}" for c in more]]]))
    found = table.join(F.broadcast(offsets), "range")
    return found.select(*rows.columns, *[(F.col(c) + F.col(f"before_{c}")).alias(c) for c in more])


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n + 1, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _joined(first: tuple[int, ...], then: tuple[int, ...]) -> tuple[int, ...]:
    """(turns, key, key) of a stretch and of the stretch behind it, as one."""
    return first[0] + then[0], *[(a + pow(b, first[0], 1 << 64) * c) & _WORD for a, c, b in zip(first[1:], then[1:], BASES, strict=True)]


_CHAIN = ["depth", "key1", "key2", "up1", "up2"]


def _chain(new: np.ndarray, labels: np.ndarray, carry: tuple[int, ...]) -> tuple[list[np.ndarray], tuple[int, ...]]:
    """Depths and keys of sorted rows; ``new`` marks the first row of a sequence, ``carry`` is the stretch that the rows before the first ``new`` go on."""
    n = len(new)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    going = ~np.logical_or.accumulate(new)  # rows that go on the carried stretch
    depth = np.arange(n) - start + 1 + np.where(going, carry[0], 0)
    keys, ups = [], []
    with np.errstate(over="ignore"):
        for k, (base, inverse) in enumerate(zip(BASES, _INVERSE, strict=True)):
            terms = labels[:, k] * _powers(base, n)[:n]
            total = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
            down = _powers(inverse, n)[start]
            key, up = (total[1:] - total[start]) * down, (total[:-1] - total[start]) * down
            ahead = np.uint64(pow(base, carry[0], 1 << 64))
            keys.append(np.where(going, np.uint64(carry[1 + k]) + ahead * key, key))
            ups.append(np.where(going, np.uint64(carry[1 + k]) + ahead * up, up))
    return [depth, *keys, *ups], (int(depth[-1]), int(keys[0][-1]), int(keys[1][-1]))


def chained(scratch: Scratch, rows: DataFrame, sequence: str, order: list[str], parts: int) -> DataFrame:
    """``rows`` with their ``depth`` (place in their sequence, from 1), a 128-bit key (``key1``, ``key2``) of the labels up to and with
    the row, and the key up to the row before (``up1``, ``up2``; zeros at depth 1). ``label`` holds 16 random-looking bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, carry, at, opened = TaskContext.get().partitionId(), None, (0, 0, 0), 0, True
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            ids = b.column(sequence)
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)
            new[0] = last is not None and ids[0].as_py() != last
            last = ids[-1].as_py()
            label = b.column("label").cast(pa.binary(16))
            values, carry = _chain(new, np.frombuffer(label.buffers()[1], "<u8").reshape(-1, 2)[label.offset : label.offset + n], carry)
            goes_on = ~np.logical_or.accumulate(new) & opened
            opened = bool(goes_on[-1])
            arrays = [pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for v in values]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays, pa.array(goes_on), pa.array(np.full(n, pid, np.int64)), pa.array(np.arange(at, at + n))], [*b.schema.names, *_CHAIN, "open", "range", "place"])
            at += n

    long = T.LongType()
    schema = with_fields(rows.schema, *[T.StructField(c, long) for c in _CHAIN], T.StructField("open", T.BooleanType()), T.StructField("range", long), T.StructField("place", long))
    table = scratch.put(sorted_ranges(rows, [sequence, *order], parts).mapInArrow(run, schema))
    end = F.max_by(F.struct(F.col(sequence).alias("id"), "depth", "key1", "key2", "open"), "place").alias("end")
    got = sorted(table.groupBy("range").agg(F.min_by(sequence, "place").alias("first"), end).collect(), key=lambda r: r["range"])  # a row for each range
    ahead: dict[int, tuple[int, ...]] = {}
    last, carry = None, (0, 0, 0)
    for r in got:
        if goes_on := last is not None and r["first"] == last:
            ahead[r["range"]] = carry
        own = (r["end"]["depth"], r["end"]["key1"] & _WORD, r["end"]["key2"] & _WORD)
        carry = _joined(carry, own) if goes_on and r["end"]["open"] else own
        last = r["end"]["id"]
    return _mended(table, ahead).drop("open", "range", "place")


def _mended(table: DataFrame, ahead: dict[int, tuple[int, ...]]) -> DataFrame:
    """Add to the sequence that a range goes on what the ranges before hold of it."""
    if not ahead:
        return table
    rest, cut = table.where(~F.col("open") | ~F.col("range").isin(*ahead)), table.where(F.col("open") & F.col("range").isin(*ahead))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [ahead[r] for r in b.column("range").to_pylist()]
            columns = {c: b.column(c) for c in b.schema.names}
            columns["depth"] = pa.array(b.column("depth").to_numpy() + np.array([p[0] for p in parts], np.int64))
            with np.errstate(over="ignore"):
                for k, base in enumerate(BASES):
                    power = {p[0]: pow(base, p[0], 1 << 64) for p in set(parts)}
                    base_key, factor = np.array([p[1 + k] for p in parts], np.uint64), np.array([power[p[0]] for p in parts], np.uint64)
                    for c in (f"key{k + 1}", f"up{k + 1}"):
                        columns[c] = pa.array((base_key + factor * b.column(c).to_numpy().view(np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_pydict(columns, schema=b.schema)

    return rest.unionByName(cut.mapInArrow(run, table.schema))
