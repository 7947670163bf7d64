from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import functions as F

from brindle.operators import digests, manifest
from brindle.operators.digests import Tree
from brindle.sources.changes import FolderChanges


def test_a_small_change_reads_few_buckets(spark, tmp_path):
    old = spark.range(3000).select(F.col("id").cast("string").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), (F.col("id") % 5).alias("size"))
    new = old.where("path NOT IN ('7', '1999')").withColumn("digest", F.when(F.col("path").isin("12", "13"), "x").otherwise(F.col("digest"))).unionByName(spark.createDataFrame([("new", None, 1)], old.schema))
    a, b = (Tree.write(rows, f"file://{tmp_path}/{n}", "path", "path", "digest", "size") for n, rows in (("a", old), ("b", new)))
    got = {r["key"]: r["change"] for r in digests.difference(a, b).collect()}
    assert got == {"7": "removed", "1999": "removed", "12": "changed", "13": "changed", "new": "added"}
    assert got == {r["path"]: r["change"] for r in manifest.difference(old, new.withColumn("digest", F.coalesce("digest", F.lit("none"))), "path", "digest").where("change <> 'unchanged'").collect()}
    tops, buckets = digests.differing(a, b)
    assert len(tops) <= 5 and buckets.count() <= 5 and a.count() == 3000 and b.count() == 2999
    plan = digests.difference(a, b)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [top#") >= 2 and len(a.rows().inputFiles()) > 200
    assert not digests.equal(a, b) and digests.equal(a, Tree.write(old.repartition(7), f"file://{tmp_path}/c", "path", "size", "digest", "path"))


def test_empty_and_equal_trees(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    full, none = Tree.write(rows, f"file://{tmp_path}/f", "id", "v"), Tree.write(rows.limit(0), f"file://{tmp_path}/n", "id", "v")
    assert digests.difference(full, full).count() == 0 and none.count() == 0
    assert sorted(tuple(r) for r in digests.difference(none, full).collect()) == [(1, "added"), (2, "added")]
    assert {r["change"] for r in digests.difference(full, none).collect()} == {"removed"}


def test_folder_changes_as_a_stream(spark, tmp_path):
    """Three rounds of changes give three batches; a restart repeats none."""
    spark.dataSource.register(FolderChanges)
    folder = tmp_path / "in" / "sub"
    folder.mkdir(parents=True)
    batches = []

    def go():
        rows = spark.readStream.format("folder_changes").option("state", f"file://{tmp_path}/state").option("suffix", ".md").load(f"file://{tmp_path}/in")
        q = rows.writeStream.foreachBatch(lambda b, n: batches.append(sorted((os.path.basename(r["path"]), r["change"]) for r in b.collect()))).option("checkpointLocation", f"file://{tmp_path}/log").trigger(once=True).start()
        q.awaitTermination()

    (folder / "a.md").write_text("one")
    (folder / "b.md").write_text("two")
    (folder / "c.txt").write_text("no")
    go()
    (folder / "a.md").write_text("longer")
    (folder / "b.md").unlink()
    (tmp_path / "in" / "d.md").write_text("new")
    go()
    go()
    (tmp_path / "in" / "d.md").unlink()
    go()
    assert [b for b in batches if b] == [[("a.md", "added"), ("b.md", "added")], [("a.md", "changed"), ("b.md", "removed"), ("d.md", "added")], [("d.md", "removed")]]


def test_identity_is_the_hash_of_canonical_json(spark):
    rows = [("docs/ü.md", "a" * 64, 3), ("docs/a\"b.md", "b" * 64, 0), ("docs/Z.md", "c" * 64, 7), ("docs/😀.md", "d" * 64, 1), ("docs/\uffee.md", "e" * 64, 2)]
    files = spark.createDataFrame(rows, "path string, content_sha256 string, chunk_count int").repartition(3)
    settings = {"collection_name": "notes", "model": "模型", "dimensions": 8, "chunk_size": 5, "chunk_overlap": 1}
    listed = [{"path": p, "content_sha256": h, "chunk_count": n} for p, h, n in sorted(rows)]
    whole = {"schema_version": 1, "collection_name": "notes", "embedding": {"model": "模型", "dimensions": 8}, "chunking": {"chunk_size": 5, "chunk_overlap": 1}}
    for some, of in ((files, listed), (files.limit(0), [])):
        want = whole | {"corpus": {"file_count": len(of), "chunk_count": sum(f["chunk_count"] for f in of), "files": of}}
        canonical = json.dumps(want, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        assert manifest.identity(some, **settings) == "sha256:" + hashlib.sha256(canonical.encode()).hexdigest()
