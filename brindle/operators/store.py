"""Tables as versioned Parquet folders: rebuild, upsert, delete, snapshot sync, compare-and-set, each with a switch at the end.

A table lies below ``root`` as folders and a log of numbered records, the newest of which names the live ones. A writer fills a new folder and then creates
the next record, so readers see the old rows or the new, never a mixture, and a failed write changes nothing. A table with a ``key`` is dealt into buckets
by its hash; a change by that key reads and rewrites the buckets it touches and no others.

Several writers may work at once. One that finds its number taken keeps its work if the others touched other buckets, and else works it out again from
what is live now, RETRIES times; after that it fails with ``Conflict`` and has changed nothing. Folders of old records stay until ``vacuum``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import relational
from brindle.operators.commits import Conflict, Log

BUCKET = "__bucket"
RETRIES = 5


class Store:
    def __init__(self, spark: SparkSession, root: str, key: str | None = None, buckets: int = 64):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets if key else 1
        self.log = Log(spark, self.root)

    def _commit(self) -> dict | None:
        return self.log.latest()[1]

    def exists(self) -> bool:
        return bool(self.log.numbers())

    def _bucket(self) -> F.Column:
        return (F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)) if self.key else F.lit(0)).cast("int")

    def _read(self, record: dict | None, only: set[int] | None = None) -> DataFrame:
        parts = [p for b, p in record["parts"].items() if only is None or int(b) in only]
        schema = self.spark.read.schema(record["schema"])
        return schema.parquet(*[f"{self.root}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], record["schema"])

    def read(self) -> DataFrame:
        record = self._commit()
        if record is None:
            raise ValueError(f"no table at {self.root}")
        return self._read(record)

    def count(self) -> int:
        return self.read().count() if self.exists() else 0

    def lookup(self, keys: Sequence) -> DataFrame:
        """The rows of some keys. Only the buckets of these keys are opened, and in them the row groups whose Bloom filters may hold one."""
        record = self._commit()
        if record is None:
            raise ValueError(f"no table at {self.root}")
        kind = next(f.dataType for f in self._read(record, set()).schema if f.name == self.key)
        wanted = self.spark.createDataFrame([(k,) for k in keys], "k string").select(F.col("k").cast(kind).alias(self.key)) if keys else self._read(record, set()).select(self.key)
        some = {r[0] for r in wanted.select(self._bucket()).distinct().collect()}  # as many as keys given
        return self._read(record, some).where(F.col(self.key).isin(list(keys)))

    def _stage(self, rows: DataFrame) -> dict[str, str]:
        """Write rows into a folder of their own; the buckets it has."""
        folder = f"data-{uuid4().hex[:12]}"
        dealt = rows.withColumn(BUCKET, self._bucket())
        if self.key:
            dealt = dealt.repartition(BUCKET).sortWithinPartitions(BUCKET, self.key)
        out = dealt.write.partitionBy(BUCKET)
        if self.key:
            out = out.option(f"parquet.bloom.filter.enabled#{self.key}", "true")
        out.parquet(f"{self.root}/{folder}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        return {str(b): f"{folder}/{BUCKET}={b}" for b in range(self.buckets) if fs.exists(path(f"{self.root}/{folder}/{BUCKET}={b}"))}

    def _change(self, work: Callable[[dict | None], tuple[DataFrame, set[int] | None]]) -> DataFrame:
        """``work`` gives, from the live record, the new rows of the buckets that it touches (none: of all). The table after the change."""
        for _ in range(RETRIES):
            number, record = self.log.latest()
            rows, touched = work(record)
            new = self._stage(rows)
            schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
            while True:
                kept = {} if record is None or touched is None else {b: p for b, p in record["parts"].items() if int(b) not in touched}
                if self.log.create(number + 1, {"parts": {**kept, **new}, "schema": schema, "touched": None if touched is None else sorted(touched)}):
                    return self._read({"parts": {**kept, **new}, "schema": schema})
                number, record = number + 1, self.log.read(number + 1)
                if touched is None or record["touched"] is None or touched & set(record["touched"]) or record["schema"] != schema:
                    break  # work it out again
        raise Conflict(f"{self.root} was changed by others {RETRIES} times")

    def rebuild(self, rows: DataFrame) -> DataFrame:
        """Replace everything."""
        return self._change(lambda record: (rows, None))

    def _of(self, keys: DataFrame) -> set[int]:
        """The buckets of some keys: a number for each bucket at most."""
        return {r[0] for r in keys.select(self._bucket()).distinct().collect()}

    def _changed(self, keys: DataFrame, by: str, change: Callable[[DataFrame], DataFrame], first: DataFrame | None = None) -> DataFrame:
        """Change the rows of the buckets that the keys fall into; ``first``: what to write where there is no table yet."""

        def work(record: dict | None) -> tuple[DataFrame, set[int] | None]:
            if record is None:
                if first is None:
                    raise ValueError(f"no table at {self.root}")
                return first, None
            touched = self._of(keys) if by == self.key else None
            return change(self._read(record, touched)), touched

        return self._change(work)

    def upsert(self, rows: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
        return self._changed(rows, key, lambda old: relational.upsert(old, rows, key, keep), rows)

    def delete(self, keys: DataFrame, key: str) -> DataFrame:
        return self._changed(keys, key, lambda old: relational.delete(old, keys, key))

    def delete_where(self, condition) -> DataFrame:
        return self._change(lambda record: (self._read(record).where(~F.coalesce(condition, F.lit(False))), None))

    def replace_groups(self, rows: DataFrame, group: str, remove: DataFrame | None = None) -> DataFrame:
        """All old rows of the groups that occur in ``rows`` (or ``remove``) give way to them, so a shorter group leaves no tail."""
        groups = rows.select(group) if remove is None else rows.select(group).unionByName(remove.select(group))
        return self._changed(groups, group, lambda old: old.join(groups.distinct(), group, "left_anti").unionByName(rows), rows)

    def compare_and_set(self, attempts: DataFrame, column: str, expected: str = "expected") -> DataFrame:
        """Rows of the table's key, ``expected`` and new values of columns, ``column`` among them: each is applied only where ``column`` still holds what is
        expected (null: null). One attempt a key at most. Key and ``won`` of every attempt, as it was when the change went in."""
        key, new = self.key, [c for c in attempts.columns if c not in (self.key, expected)]
        fits = F.col(f"__{expected}").eqNullSafe(F.col(column)) & F.col("__asked")
        named = attempts.select(key, F.lit(True).alias("__asked"), F.col(expected).alias(f"__{expected}"), *[F.col(c).alias(f"__new_{c}") for c in new])
        before: dict = {}

        def work(record: dict | None) -> tuple[DataFrame, set[int]]:
            if record is None:
                raise ValueError(f"no table at {self.root}")
            touched = self._of(attempts)
            before["rows"] = old = self._read(record, touched)
            both = old.join(named, key, "left")
            return both.select(*[F.when(F.coalesce(fits, F.lit(False)), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in old.columns]), touched

        self._change(work)
        found = named.join(before["rows"].select(key, column), key, "left")
        return found.select(key, F.coalesce(fits & F.col(key).isNotNull(), F.lit(False)).alias("won")).join(before["rows"].select(key, F.lit(True).alias("__there")), key, "left").select(key, (F.col("won") & F.coalesce("__there", F.lit(False))).alias("won"))

    def sync(self, rows: DataFrame, key: str, *, replace: bool = False, remove: DataFrame | None = None, expect: int | None = None) -> int:
        """Delete all (``replace``) or the listed keys, then upsert, in one switch; the count after it. A count other than ``expect`` is an error and
        leaves the old version live."""

        def work(record: dict | None) -> tuple[DataFrame, set[int] | None]:
            touched = None
            if replace or record is None:
                new = rows
            else:
                keys = rows.select(key) if remove is None else rows.select(key).unionByName(remove.select(key))
                touched = self._of(keys) if key == self.key else None
                old = self._read(record, touched)
                new = relational.upsert(old if remove is None else relational.delete(old, remove, key), rows, key)
            if expect is not None:
                others = {int(b) for b in record["parts"]} - touched if touched is not None else set()
                found = new.count() + (self._read(record, others).count() if others else 0)
                if found != expect:
                    raise ValueError(f"{found} rows where {expect} were expected")
            return new, touched

        return self._change(work).count()

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove all but the newest ``keep`` records and the folders that none of them names; call it while nobody writes or reads older ones."""
        self.log.prune(keep)
        named = {p.split("/")[0] for n in self.log.numbers() for p in self.log.read(n)["parts"].values()}
        fs, path = self.log._fs, self.log._path
        gone = [s.getPath() for s in fs.listStatus(path(self.root)) if s.getPath().getName().startswith("data-") and s.getPath().getName() not in named]
        for p in gone:
            fs.delete(p, True)
        return sorted(p.getName() for p in gone)

    def backup(self, folder: str, stamp: str, keep: int) -> list[str]:
        """Copy the live rows to ``folder``/backup-<stamp> and keep the newest ``keep`` copies by their stamps, this one included; the names kept, newest first.

        A copy gets its name when it is whole, so an interrupted one is never taken for a backup; nothing is removed before that."""
        if keep < 1:
            raise ValueError("at least one backup is kept")
        fs, path = self.log._fs, self.log._path
        top = folder.rstrip("/")
        target = path(f"{top}/backup-{stamp}")
        if fs.exists(target):
            raise ValueError(f"there is a backup of {stamp}")
        self.read().write.mode("overwrite").parquet(f"{top}/.backup-{stamp}")
        if not fs.rename(path(f"{top}/.backup-{stamp}"), target):
            raise OSError(f"cannot name the backup of {stamp}")
        names = sorted((s.getPath().getName() for s in fs.listStatus(path(top)) if s.getPath().getName().startswith("backup-")), reverse=True)
        for old in names[keep:]:
            fs.delete(path(f"{top}/{old}"), True)
        return names[:keep]

    def restore(self, folder: str, name: str) -> DataFrame:
        """Replace everything by a backup's rows."""
        return self.rebuild(self.spark.read.parquet(f"{folder.rstrip('/')}/{name}"))

    def problems(self, key: str) -> DataFrame:
        """Keys that occur more than once."""
        return self.read().groupBy(key).count().where("count > 1")


def canonical_lines(rows: DataFrame) -> DataFrame:
    """Rows as compact JSON lines with sorted keys, nulls kept."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}).alias("value"))


def write_lines(rows: DataFrame, path: str) -> None:
    canonical_lines(rows).write.mode("overwrite").text(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def markdown_table(rows: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; more than ``most`` rows is an error, as the driver formats it."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in got)]) + "\n"


def keep_newest(files: DataFrame, n: int, order: str = "modificationTime") -> DataFrame:
    """Backups beyond the newest n: what may be removed."""
    newest = files.orderBy(F.desc(order), "path").limit(n)
    return files.join(newest.select("path"), "path", "left_anti")
