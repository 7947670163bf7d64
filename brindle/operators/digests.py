"""Snapshots as trees of digests, compared from the root down.

A row's digest stands in the bucket of its key's hash; buckets' digests are combined on three levels (two hexadecimal digits, then ``digits``, then
the rows). Two snapshots that agree in a node agree in all below it, so a comparison reads the small levels and then the rows of those buckets
that differ, and joins nothing else. What it costs follows the change, not the snapshot.

Keys are unique and not null; ``digits`` (even, at most 6) is chosen so that a bucket holds some thousand rows. An empty snapshot is a tree too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import manifest


def _combined(names: str, digests: str) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(names, digests))), lambda x: x[digests]), "\n"), 256)


class Tree:
    """A stored tree; ``Tree.write`` makes one, ``Tree(spark, root)`` opens it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.record = manifest.read_commit(spark, f"{self.root}/tree.json")
        if self.record is None:
            raise ValueError(f"no tree at {root}")

    @classmethod
    def write(cls, rows: DataFrame, root: str, key: str, *columns: str, digits: int = 4) -> Tree:
        """Store the digests of some columns of each row, by key. The record is written last."""
        spark, root = rows.sparkSession, root.rstrip("/")
        digest = F.sha2(F.to_json(F.struct(*[F.col(c).alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)
        leaves = rows.select(F.col(key).alias("key"), digest.alias("h"), F.substring(F.sha2(F.col(key).cast("string"), 256), 1, digits).alias("bucket"))
        leaves = leaves.withColumn("top", F.substring("bucket", 1, 2))
        leaves.repartitionByRange("bucket").sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("top").parquet(f"{root}/rows")
        kind = dict(leaves.dtypes)["key"]
        stored = spark.read.schema(f"key {kind}, h string, bucket string, top string").parquet(f"{root}/rows")
        buckets = stored.groupBy("bucket").agg(_combined("key", "h").alias("h"), F.count("*").alias("n")).withColumn("top", F.substring("bucket", 1, 2))
        buckets.repartitionByRange("bucket").sortWithinPartitions("bucket").write.mode("overwrite").parquet(f"{root}/buckets")
        tops = cls._buckets(spark, root).groupBy("top").agg(_combined("bucket", "h").alias("h"), F.sum("n").alias("n"))
        found = {r["top"]: [r["h"], r["n"]] for r in tops.collect()}  # 256 at most
        manifest.write_commit(spark, f"{root}/tree.json", {"kind": kind, "digits": digits, "tops": found})
        return cls(spark, root)

    @staticmethod
    def _buckets(spark: SparkSession, root: str) -> DataFrame:
        return spark.read.schema("bucket string, h string, n bigint, top string").parquet(f"{root}/buckets")

    def count(self) -> int:
        return sum(n for _, n in self.record["tops"].values())

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"key {self.record['kind']}, h string, bucket string, top string").parquet(f"{self.root}/rows")


def differing(old: Tree, new: Tree) -> tuple[list[str], DataFrame]:
    """The tops, and the buckets below them, in which two trees differ."""
    if (old.record["kind"], old.record["digits"]) != (new.record["kind"], new.record["digits"]):
        raise ValueError("trees of other keys or widths")
    a, b = old.record["tops"], new.record["tops"]
    tops = sorted(t for t in {*a, *b} if a.get(t) != b.get(t))
    left, right = (Tree._buckets(t.spark, t.root).where(F.col("top").isin(tops)) for t in (old, new))
    both = left.select("top", "bucket", F.col("h").alias("a")).join(right.select("top", "bucket", F.col("h").alias("b")), ["top", "bucket"], "full_outer")
    return tops, both.where(~F.col("a").eqNullSafe(F.col("b"))).select("top", "bucket")


def difference(old: Tree, new: Tree) -> DataFrame:
    """key and ``change`` (added, changed or removed) of the rows that differ. Folders of equal tops are not opened, rows of equal buckets not joined."""
    tops, buckets = differing(old, new)
    part = lambda t: t.rows().where(F.col("top").isin(tops)).join(F.broadcast(buckets), ["top", "bucket"], "left_semi")  # noqa: E731  16 ** digits buckets at most
    a, b = part(old).select("key", "bucket", F.col("h").alias("a")), part(new).select("key", "bucket", F.col("h").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return a.join(b, ["bucket", "key"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("key", change.alias("change"))


def equal(old: Tree, new: Tree) -> bool:
    """Whether both hold the same rows; reads the two records alone."""
    return old.record["tops"] == new.record["tops"]
