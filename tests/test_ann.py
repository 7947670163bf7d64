from __future__ import annotations

import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import ann, manifest, vector
from brindle.session import shared_folder


def table(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v], i % 3) for i, v in enumerate(vectors)], "id long, embedding array<float>, kind int")


def clustered(n, centres=30, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, 32))
    return middle[rng.integers(0, centres, n)] + 0.25 * rng.normal(size=(n, 32))


def asked(entries):
    return entries.where("id % 50 = 0").select(F.col("id").alias("q"), F.col("embedding").alias("query_embedding"))


@pytest.fixture(scope="module")
def index(spark):
    return ann.VectorIndex.build(table(spark, clustered(4000)), shared_folder(spark, "ann"), key="id")


def test_kmeans_against_plain_rounds():
    points = np.concatenate([np.full((20, 2), c, np.float32) + np.arange(20)[:, None] * 0.01 for c in (0.0, 5.0, -7.0)])
    centres = ann.kmeans(points, 3)
    want = sorted(points[i : i + 20].mean(0).tolist() for i in (0, 20, 40))
    assert np.allclose(sorted(centres.tolist()), want, atol=1e-4)
    at, _ = ann._nearest(points, centres)
    assert (at == ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)).all()


def test_codes_stand_for_products():
    """A query's product with an entry's cell and codes is that with the vector they decode to."""
    points = clustered(800).astype(np.float32)
    q = ann.Quantiser.train(points, 8, 5)
    cell, codes = q.encode(points[:50])
    back = q.centres[cell] + np.concatenate([book[codes[:, j]] for j, book in enumerate(q.books)], axis=1)[:, :32]
    tables = q.tables(points[60:70])
    got = points[60:70] @ q.centres[cell].T + sum(tables[:, j][:, codes[:, j]] for j in range(5))
    assert np.allclose(got, points[60:70] @ back.T, atol=1e-3)


def test_recall_and_pruning_on_clustered_vectors(spark, index):
    entries = index.entries().select("id", "embedding", "kind")
    exact = vector.topk_many(entries, asked(entries), 10, key="id", query_key="q")
    found = index.topk_many(asked(entries), 10, query_key="q")
    assert ann.recall(exact, found, query_key="q", key="id") >= 0.95
    assert index.record["cells"] == 126 and index.record["probes"] <= 60
    vec = [float(x) for x in entries.where("id = 7").first()["embedding"]]
    plan = index.topk(vec, 3, probes=4)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [__bucket" in plan and "PushedFilters: [In(__cell" in plan
    rows = index.topk(vec, 3).collect()
    assert rows[0]["id"] == 7 and [r["id"] for r in rows] == [r["id"] for r in vector.topk(entries, vec, 3, key="id").collect()]


def test_recall_at_sf01(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    entries = spark.read.parquet(path).withColumnRenamed("vec_id", "id")
    made = ann.VectorIndex.build(entries, shared_folder(spark, "ann"), key="id")
    exact = vector.topk_many(entries, asked(entries), 10, key="id", query_key="q")
    assert ann.recall(exact, made.topk_many(asked(entries), 10, query_key="q"), query_key="q", key="id") >= 0.9
    assert made.record["probes"] < made.record["cells"]


def test_all_cells_and_deep_ranking_are_exact(index):
    entries = index.entries().select("id", "embedding", "kind")
    want = vector.topk_many(entries.where("kind = 1"), asked(entries), 5, key="id", query_key="q").collect()
    got = index.topk_many(asked(entries), 5, query_key="q", probes=126, rerank=800, where=F.col("kind") == 1, block=17).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_added_entries_are_found(spark):
    root = shared_folder(spark, "ann")
    made = ann.VectorIndex.build(table(spark, clustered(500)), root, key="id", cells=10)
    more = table(spark, clustered(100, seed=5), first=10_000)
    made.add(more)
    again = ann.VectorIndex(spark, root)
    assert again.entries().count() == 600 and len(again.record["segments"]) == 2
    found = again.topk_many(more.select(F.col("id").alias("q"), F.col("embedding").alias("query_embedding")), 1, query_key="q", probes=10).collect()
    assert len(found) == 100 and all(r["q"] == r["id"] for r in found)


def test_odd_vectors(spark):
    rows = [(i, v) for i, v in enumerate([[1.0, 0.0], [0.0, 1.0], None, [], [0.0, 0.0], [1.0, 2.0, 3.0], [1.0, 0.0], [float("nan"), 1.0], [-1.0, 0.0]])]
    entries = spark.createDataFrame(rows, "id long, embedding array<double>")
    made = ann.VectorIndex.build(entries, shared_folder(spark, "ann"), key="id", cells=2)
    assert made.entries().count() == 8
    queries = spark.createDataFrame([("a", [2.0, 0.0]), ("b", []), ("c", None)], "q string, query_embedding array<double>")
    got = {(r["q"], r["rank"]): (r["id"], r["similarity"]) for r in made.topk_many(queries, 3, query_key="q", probes=2, rerank=9).collect()}
    assert [got["a", i] for i in (1, 2)] == [(0, 1.0), (6, 1.0)]
    assert made.topk([1.0, 0.0], 0).count() == 0


def test_empty_table(spark):
    made = ann.VectorIndex.build(spark.createDataFrame([], "id long, embedding array<float>"), shared_folder(spark, "ann"), key="id")
    queries = spark.createDataFrame([(1, [1.0])], "q long, query_embedding array<double>")
    assert made.topk_many(queries, 3, query_key="q").count() == 0 and made.topk([1.0, 2.0], 3).count() == 0


def test_listing_marks_files_and_conditions(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/t")
    read = lambda: spark.read.parquet(f"{tmp_path}/t")
    assert manifest.listing(read()) == manifest.listing(read()) != manifest.listing(read().where("id > 2"))
    assert manifest.listing(read().where("id > 2")) != manifest.listing(read().where("id > 3"))
    before = manifest.listing(read())
    spark.range(1).write.mode("append").parquet(f"{tmp_path}/t")
    assert manifest.listing(read()) != before
    with pytest.raises(ValueError):
        manifest.listing(spark.createDataFrame([(uuid.uuid4().hex,)], "x string"))


@pytest.mark.parametrize("vectors", [np.random.default_rng(2).normal(size=(3000, 24)), clustered(3000)])
def test_exact_search_misses_nothing(spark, vectors):
    """The nearest of vectors that hardly cluster lie in cells far away too."""
    entries = table(spark, vectors)
    made = ann.VectorIndex.build(entries, shared_folder(spark, "ann"), key="id")
    for k in (2, 10):
        want = vector.topk_many(entries, asked(entries), k, key="id", query_key="q").collect()
        assert sorted(map(tuple, made.topk_many(asked(entries), k, query_key="q", exact=True).collect())) == sorted(map(tuple, want))


def test_exact_search_of_odd_vectors(spark):
    rows = [(i, v) for i, v in enumerate([[1.0, 0.0], [0.0, 1.0], None, [], [0.0, 0.0], [1.0, 2.0, 3.0], [1.0, 0.0], [float("nan"), 1.0], [-1.0, 0.0]])]
    made = ann.VectorIndex.build(spark.createDataFrame(rows, "id long, embedding array<double>"), shared_folder(spark, "ann"), key="id", cells=2)
    queries = spark.createDataFrame([("a", [2.0, 0.0]), ("b", []), ("c", None)], "q string, query_embedding array<double>")
    got = {(r["q"], r["rank"]): (r["id"], r["similarity"]) for r in made.topk_many(queries, 4, query_key="q", exact=True).collect()}
    assert [got["a", i] for i in (1, 2, 3, 4)] == [(0, 1.0), (6, 1.0), (1, 0.0), (3, 0.0)]
    assert all([got[q, i] for i in (1, 2, 3, 4)] == [(0, 0.0), (1, 0.0), (3, 0.0), (4, 0.0)] for q in "bc")


def test_cells_out_of_reach_are_passed_over(monkeypatch):
    scored, best = [], vector._best
    monkeypatch.setattr(vector, "_best", lambda wanted, n, batch, k: scored.append(n * batch.num_rows) or best(wanted, n, batch, k))
    points = np.repeat(np.eye(8, dtype=np.float32), 100, axis=0) + 0.01 * np.random.default_rng(0).normal(size=(800, 8)).astype(np.float32)
    points /= np.sqrt((points**2).sum(1, keepdims=True))
    import pyarrow as pa

    scan, kept = ann._Whole(np.eye(8, dtype=np.float32), points[::100].astype(float).tolist(), 3), None
    for cell in range(8):
        own = points[100 * cell : 100 * cell + 100].astype(float).tolist()
        kept = scan.add(pa.record_batch({"id": np.arange(100) + 100 * cell, "e": pa.array(own), "__cell": pa.array([cell] * 100, pa.int32())}), kept)
    assert kept.num_rows == 24 and (kept["id"].to_numpy() // 100 == kept["__query"].to_numpy()).all() and sum(scored) < 8 * 800


def test_scores_at_a_time_do_not_grow_with_the_block(monkeypatch, spark):
    assert vector.rows_at_once(4096) * 4096 <= vector.CELLS and vector.rows_at_once(1) == 4096
    entries = table(spark, clustered(700))
    want = vector.topk_many(entries, asked(entries), 5, key="id", query_key="q").collect()
    monkeypatch.setattr(vector, "rows_at_once", lambda n: 67)
    assert sorted(map(tuple, vector.topk_many(entries, asked(entries), 5, key="id", query_key="q").collect())) == sorted(map(tuple, want))
