"""Scratch tables in the folder that all executors share, and helpers for Arrow batches.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` (any Hadoop file system) and reading it back: a lost
executor loses nothing that later stages need. Only where that setting is absent and Spark runs in one process (tests) a local folder is made; on a
cluster its absence is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI; this application's scratch tables lie below it."""
    app = spark.sparkContext.applicationId
    top = spark.conf.get("spark.checkpoint.dir", None) or _own.get(app)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        top = _own[app] = "file://" + tempfile.mkdtemp(prefix="brindle-")
    return f"{top.rstrip('/')}/brindle-{app}"


def _hadoop(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, uri: str) -> None:
    fs, path = _hadoop(spark, uri)
    fs.delete(path, True)


def make_dir(spark: SparkSession, uri: str) -> str:
    fs, path = _hadoop(spark, uri)
    fs.mkdirs(path)
    return uri


class Scratch:
    """Tables of one operator run. ``put`` writes a table and returns it reread; ``drop`` deletes one that nothing needs any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.top}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def dir(self) -> str:
        self.n += 1
        return make_dir(self.spark, f"{self.top}/{self.n}")

    def drop(self, number: int) -> None:
        remove(self.spark, f"{self.top}/{number}")

    def clear(self) -> None:
        remove(self.spark, self.top)


def clear_all(spark: SparkSession) -> None:
    """Delete every scratch table of this application; call it when no lazy result of an operator is still to be read."""
    remove(spark, shared_dir(spark))


def positional(docs: DataFrame) -> DataFrame:
    """The columns named c0, c1, ... by place: dots, repeated names and names in another case cannot be mistaken then. ``toDF`` names them back."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def own_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads, so extra columns of any name are left out and not scanned."""
    return positional(docs).select(*[F.col(f"c{docs.columns.index(n)}").alias(n) for n in names])


def without(docs: DataFrame, *outputs: str) -> tuple[DataFrame, list[str]]:
    """The input by place (``positional``) without columns whose name (in any case) an operator is about to add, and the names of what is left."""
    taken = {o.lower() for o in outputs}
    left = [i for i, c in enumerate(docs.columns) if c.lower() not in taken]
    return positional(docs).select(*[f"c{i}" for i in left]).toDF(*[f"c{k}" for k in range(len(left))]), [docs.columns[i] for i in left]


def with_fields(schema: T.StructType, *more: T.StructField) -> T.StructType:
    return T.StructType([*schema.fields, *more])


def raw(texts: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 of each text without decoding it; None for null."""
    return (None if t is None else t for t in texts.cast(pa.binary()).to_pylist())


def spans(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to ``most`` at most, or one longer item alone."""
    lo, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > lo and total + size > most:
            yield lo, i
            lo, total = i, 0
        total += size
    if len(sizes) > lo:
        yield lo, len(sizes)


def byte_sizes(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def pieces(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of bounded text size."""
    for lo, hi in spans(byte_sizes(batch.column(column)), most):
        yield batch.slice(lo, hi - lo)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts one after another, and the offset of each text (one more than texts). Null counts as empty."""
    import pyarrow.compute as pc

    whole = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(whole) else (data[:0], np.zeros(1, np.int64))


def crc32_sql(text: str) -> str:
    """DuckDB has no CRC-32: the plain bitwise rule over the ASCII bytes of a string."""
    byte = "list_reduce([xor(crc, octet), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, rest: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda crc, octet: {byte}), 4294967295)"


#: Bytes of input that one range should hold about.
RANGE_BYTES = 8 << 20


def range_count(rows: DataFrame, least: int) -> int:
    """How many ranges to deal a table into: by its size as the plan estimates it (where it does), the session's shuffle partitions at least."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    by_size = -(-size // RANGE_BYTES) if size < 1 << 60 else 0  # larger: unknown
    return max(least, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1 << 14, by_size))


class Ranges:
    """Ranges of like counts in the order of a key, nulls first, then of a row hash: for sorting a table by many tasks.

    Quantiles come from one pass over the key column alone. A key (or null) that fills several ranges is dealt over them by the hash, so only rows
    equal in key and hash must share one."""

    def __init__(self, rows: DataFrame, key: str, parts: int):
        at = [i / parts for i in range(1, parts)] or [0.5]
        got = rows.agg(F.percentile_approx(key, at, max(10_000, 20 * parts)).alias("q"), F.count("*").alias("n"), F.count_if(F.col(key).isNull()).alias("nulls")).first()
        self.cuts = sorted(got["q"] or []) if parts > 1 else []
        self.null_parts = max(1, round(parts * got["nulls"] / got["n"])) if got["n"] else 1
        self.count = self.null_parts + len(self.cuts)

    def part(self, key, row_hash):
        """The number of a row's range: 0, 1, ... in the order of (key, hash)."""
        cuts = sorted(set(self.cuts))
        below = {c: sum(x < c for x in self.cuts) for c in cuts}

        def search(lo: int, hi: int):
            if lo == hi:
                return F.lit(below[cuts[lo]] if lo < len(cuts) else len(self.cuts))
            mid = (lo + hi) // 2
            return F.when(key > F.lit(cuts[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

        if len(cuts) <= 512:
            plain = search(0, len(cuts))
        else:  # a search tree over blocks of cuts, then the cuts of one block
            all_cuts, block = F.array(*[F.lit(c) for c in self.cuts]), 128

            def blocks(lo: int, hi: int):
                if lo == hi:
                    return F.lit(lo)
                mid = (lo + hi) // 2
                return F.when(key > F.lit(self.cuts[(mid + 1) * block - 1]), blocks(mid + 1, hi)).otherwise(blocks(lo, mid))

            at = blocks(0, (len(self.cuts) - 1) // block)
            plain = at * block + F.size(F.filter(F.slice(all_cuts, at * block + 1, F.lit(block)), lambda c: c < key))
        share = row_hash / F.lit(2.0**64) + 0.5
        deal = lambda n: F.least(F.lit(n - 1), F.floor(F.lit(n) * share).cast("int"))
        repeats = {c: self.cuts.count(c) for c in cuts if self.cuts.count(c) > 1}
        within = F.lit(0)
        for c, n in repeats.items():
            within = F.when(key == F.lit(c), deal(n)).otherwise(within)
        shift = self.null_parts - 1
        return F.when(key.isNull(), deal(self.null_parts) if shift else F.lit(0)).otherwise(plain + within + shift).cast("int")

    def deal(self, rows: DataFrame, part: str) -> DataFrame:
        """Rows dealt by the number of their range, each range to a task of its own.

        Spark deals by a hash of the column, so each range is given a value whose hash leads to its own task; by the plain number some
        tasks would get several ranges and others none."""
        n = self.count
        numbers = rows.sparkSession.range(32 * n).select(F.col("id").cast("int").alias("x"))
        found = {r["t"]: r["x"] for r in numbers.groupBy(F.pmod(F.hash("x"), F.lit(n)).alias("t")).agg(F.min("x").alias("x")).collect()}  # a row for each range
        values = F.array(*[F.lit(found.get(t, t)) for t in range(n)])
        return rows.withColumn("__slot", F.element_at(values, F.col(part) + 1)).repartition(n, "__slot")
