"""Content-addressed manifests: fingerprints, differences, obsolete ids, readiness; as DataFrames, with the small commit record written last."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def fingerprint(files: DataFrame, *columns: str) -> DataFrame:
    """One row: SHA-256 over the canonical JSON of all rows' columns, in the order of the first one.

    A tree of digests: rows are hashed where they lie, digests are combined in 65,536 buckets of the key's hash, those in 256, and those in one, so no
    task gathers more than its share."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c).alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)
    level = files.select(F.substring(F.sha2(F.col(columns[0]).cast("string"), 256), 1, 4).alias("p"), F.col(columns[0]).cast("string").alias("k"), row.alias("h"), F.lit(1).cast("long").alias("n"))
    both = lambda: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "\n"), 256).alias("h")
    for digits in (2, 0):
        level = level.groupBy("p").agg(both(), F.sum("n").alias("n")).select(F.substring("p", 1, digits).alias("p"), F.col("p").alias("k"), "h", "n")
    return level.agg(both().alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries"))


def identity(files: DataFrame, *, collection_name: str, model: str, dimensions: int, chunk_size: int, chunk_overlap: int) -> str:
    """The fingerprint that stored manifests of this version carry: ``sha256:`` and the hash of the canonical JSON (sorted keys, no blanks) of the
    settings and of all files (path, content_sha256, chunk_count) in order of path.

    A hash of one text is worked out in order, so one task streams the sorted files; nothing is gathered. ``fingerprint`` is the tree that
    tasks work out side by side, for snapshots that no stored manifest has to match."""
    rows = files.select("path", "content_sha256", F.col("chunk_count").cast("long").alias("chunk_count"))
    count, chunks = rows.agg(F.count("*"), F.coalesce(F.sum("chunk_count"), F.lit(0))).first()
    shown = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    payload = {
        "schema_version": SCHEMA_VERSION, "collection_name": collection_name, "embedding": {"model": model, "dimensions": dimensions},
        "chunking": {"chunk_size": chunk_size, "chunk_overlap": chunk_overlap}, "corpus": {"file_count": count, "chunk_count": chunks, "files": []},
    }
    head, tail = shown(payload).split('"files":[]')

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, comma = sha256(f'{head}"files":['.encode()), ""
        for b in batches:
            for row in b.to_pylist():
                state.update(f"{comma}{shown(row)}".encode())
                comma = ","
        state.update(f"]{tail}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([f"sha256:{state.hexdigest()}"])], ["identity"])

    found = rows.orderBy("path").coalesce(1).mapInArrow(run, "identity string").first()
    return found[0] if found else f"sha256:{sha256(shown(payload).encode()).hexdigest()}"  # an empty plan may have no task


def listed(rows: DataFrame) -> tuple[str, dict[str, str]]:
    """What a DataFrame over files will read, without opening any: its plan, and the size and time of each file by its path, as the scan has listed them.

    Files that are rewritten in place within the clock's resolution and at the same size go unnoticed. Other sources than files are an error."""
    plan = rows._jdf.queryExecution().analyzed()
    leaves, files = plan.collectLeaves(), {}
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if not leaf.getClass().getSimpleName().startswith("LogicalRelation"):
            raise ValueError("only scans of files have a listing")
        status = leaf.relation().location().allFiles().mkString("\n")
        files |= {m[1]: f"{m[2]} {m[3]}" for m in re.finditer(r"path=(.*?); isDirectory=.*?length=(\d+);.*?modification_time=(\d+);", status)}
    return plan.canonicalized().toString(), files


def listing(rows: DataFrame) -> str:
    """``listed`` as one mark."""
    plan, files = listed(rows)
    return sha256("\n".join([plan, *sorted(f"{p} {m}" for p, m in files.items())]).encode()).hexdigest()


def difference(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key and ``change``: added, changed, unchanged or removed."""
    a, b = old.select(key, F.col(digest).alias("__old")), new.select(key, F.col(digest).alias("__new"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") == F.col("__new"), "unchanged").otherwise("changed")
    return both.select(key, change.alias("change"))


def mode(changes: DataFrame, same_settings: bool, live_count_matches: bool) -> str:
    """How to refresh an index: full, unchanged or incremental."""
    if not (same_settings and live_count_matches):
        return "full"
    return "unchanged" if changes.where("change <> 'unchanged'").isEmpty() else "incremental"


def obsolete_ids(old: DataFrame, new: DataFrame, path: str, count: str) -> DataFrame:
    """Chunk ids ``path#i`` that a file had and has no longer: all of a removed file, the tail of one that got shorter."""
    a, b = old.select(path, F.col(count).alias("__old")), new.select(path, F.col(count).alias("__new"))
    rows = a.join(b, path, "left").withColumn("__new", F.coalesce("__new", F.lit(0))).where("__new < __old")
    return rows.select(path, F.explode(F.sequence(F.col("__new"), F.col("__old") - 1)).alias("i")).select(F.concat_ws("#", path, F.col("i").cast("string")).alias("chunk_id"))


def equal(a: DataFrame, b: DataFrame, *columns: str) -> bool:
    """Whether both snapshots hold the same rows, repeats counted."""
    left, right = a.select(*columns), b.select(*columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def problems(files: DataFrame, path: str = "path", digest: str = "content_sha256", count: str = "chunk_count") -> DataFrame:
    """Manifest entries that break a rule: relative POSIX path without dot segments, a 64-digit lower-case hash, a count that is not negative, unique path."""
    p = F.col(path)
    bad_path = p.isNull() | (p == "") | F.startswith(p, F.lit("/")) | F.contains(p, F.lit("\\")) | F.rlike(p, F.lit(r"(?:^|/)\.{1,2}(?:/|$)|^[A-Za-z]:"))
    bad_hash = F.col(digest).isNull() | ~F.rlike(F.col(digest), F.lit("^[0-9a-f]{64}$"))
    problem = F.when(bad_path, "path").when(bad_hash, "hash").when(F.col(count).isNull() | (F.col(count) < 0), "count")
    rows = files.select(path, problem.alias("problem")).where("problem IS NOT NULL")
    twice = files.groupBy(path).count().where("count > 1").select(path, F.lit("duplicate").alias("problem"))
    return rows.unionByName(twice)


def child_problems(children: DataFrame, kinds: tuple[str, ...] = ("jd_text", "job_info")) -> DataFrame:
    """Parents that lack exactly one child of each kind, or have a child whose id does not begin with theirs."""
    wanted = F.array(*[F.lit(k) for k in sorted(kinds)])
    rows = children.groupBy("parent_id").agg(F.array_sort(F.collect_list("child_type")).alias("kinds"), F.bool_and(F.startswith("child_id", F.concat("parent_id", F.lit(":")))).alias("prefixed"), F.countDistinct("child_id").alias("ids"))
    return rows.where((F.col("kinds") != wanted) | ~F.col("prefixed") | (F.col("ids") != len(kinds))).select("parent_id")


def subject_of(path: Column, slugs: dict[str, str]) -> Column:
    """Subject shard of a corpus path: ``docs/x.md`` is general, ``docs/<folder>/...`` the folder's slug; null for a folder that makes no slug."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    folder = F.get(parts, F.lit(1))
    known = F.create_map(*[F.lit(x) for pair in slugs.items() for x in pair]) if slugs else None
    slug = F.coalesce(F.element_at(known, folder), folder) if known is not None else folder
    slug = F.when(F.rlike(slug, F.lit("^[A-Za-z0-9][A-Za-z0-9_-]{1,61}[A-Za-z0-9]$")), slug)
    imported = (F.size(parts) >= 4) & (parts[0] == "corpus") & (F.get(parts, F.lit(2)) == "docs")
    flat = (F.size(parts) == 2) & F.endswith(F.lower(folder), F.lit(".md"))
    return F.when(imported, "llm").when((F.get(parts, F.lit(0)) == "docs") & (F.size(parts) >= 2), F.when(flat, "general").otherwise(slug)).otherwise("general")


def write_commit(spark: SparkSession, uri: str, record: dict) -> None:
    """Write the commit record last: sorted keys, two blanks of indent, a final line feed; first under another name, then renamed over the old one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    new = spark._jvm.org.apache.hadoop.fs.Path(f"{uri}.new")
    out = fs.create(new, True)
    out.write((json.dumps({"schema_version": SCHEMA_VERSION, **record}, ensure_ascii=False, sort_keys=True, indent=2) + "\n").encode())
    out.close()
    options = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(options, 1)
    how[0] = options.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration()).rename(new, path, how)  # readers see the old or the new record


def read_commit(spark: SparkSession, uri: str) -> dict | None:
    """The commit record; null if there is none, it is unreadable or of another version (not ready)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    text = "".join(r[0] + "\n" for r in spark.read.text(uri, wholetext=False).collect())
    try:
        record = json.loads(text)
    except ValueError:
        return None
    return record if record.get("schema_version") == SCHEMA_VERSION else None


def invalidate(spark: SparkSession, uri: str) -> None:
    """Remove the commit record before the first change, so that a crash leaves the index not ready."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
