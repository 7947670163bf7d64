"""Exact vector search: cosine scoring, top-k, filtered, per shard, many queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Scores that a task works out at a time.
CELLS = 1 << 20


def rows_at_once(queries: int) -> int:
    """How many rows to score against so many queries at a time."""
    return max(64, min(4096, CELLS // max(1, queries)))


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ, a vector is empty or has no length."""
    na, nb = norm(a), norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (na == 0) | (nb == 0), 0.0).otherwise(dot(a, b) / (na * nb))


def cosine_to(a: Column, vector: Sequence[float]) -> Column:
    """Cosine with one constant vector, spelled out by coordinates so it compiles into the scan's code."""
    length = sum(x * x for x in vector) ** 0.5
    if not vector or not length:
        return F.lit(0.0)
    at = [F.get(a, F.lit(i)).cast("double") for i in range(len(vector))]
    product = reduce(lambda s, c: s + c, [c * F.lit(float(x)) for c, x in zip(at, vector, strict=True)])
    own = F.sqrt(reduce(lambda s, c: s + c, [c * c for c in at]))
    return F.when((F.size(a) != len(vector)) | (own == 0), 0.0).otherwise(product / (own * F.lit(length)))


def topk(entries: DataFrame, vector: Sequence[float], k: int, *, key: str, embedding: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k most similar entries, ties by key: all columns and ``similarity``. ``where`` is applied before ranking and reaches the scan; a
    threshold belongs after it (``above``), as k counts entries, not hits. k of 0 or less gives none."""
    rows = entries if where is None else entries.where(where)
    scored = rows.withColumn("similarity", cosine_to(F.col(embedding), vector))
    return scored.orderBy(F.desc("similarity"), key).limit(max(0, k))


def above(hits: DataFrame, threshold: float, score: str = "similarity") -> DataFrame:
    return hits.where(F.col(score) >= threshold)


def topk_many(entries: DataFrame, queries: DataFrame, k: int, *, key: str, query_key: str, embedding: str = "embedding", query_embedding: str = "query_embedding", block: int = 4096) -> DataFrame:
    """query_key, key, similarity, rank: the k most similar entries of each query, ties by key.

    Queries go to the tasks in blocks of about ``block`` vectors, a pass over the entries for each; a task multiplies matrices and keeps its own best k of
    every query, so k rows a query and task are shuffled, never pairs; it scores CELLS pairs at a time, whatever the block. Similarities are rounded to twelve places, within which they tie.
    As in ``cosine``, other lengths and vectors without length score 0; null vectors are no entries."""
    spark, kinds = entries.sparkSession, dict(entries.dtypes)
    rows, asked = entries.select(key, embedding).where(F.col(embedding).isNotNull()), queries.select(query_key, query_embedding)
    schema = T.StructType([T.StructField("__query", queries.schema[query_key].dataType), entries.schema[key], T.StructField("similarity", T.DoubleType())])
    blocks = max(1, -(-asked.count() // block))
    out = None
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == i).toArrow()
        vectors = [v or [] for v in part.column(1).to_pylist()]
        shared = spark.sparkContext.broadcast((part.column(0).combine_chunks(), vectors))  # one block

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            (names, vectors), kept = shared.value, None
            wanted = _by_length(vectors)
            for batch in batches:
                for at in range(0, batch.num_rows, step := rows_at_once(len(vectors))):
                    new = _best(wanted, len(vectors), batch.slice(at, step), k)
                    kept = new if kept is None else first(pa.concat_tables([kept, new]), k)
            if kept is not None and kept.num_rows:
                kept = kept.combine_chunks()
                yield from kept.set_column(0, "__query", names.take(kept.column(0).combine_chunks())).to_batches()

        found = rows.mapInArrow(run, schema)
        best = Window.partitionBy("__query").orderBy(F.desc("similarity"), key)
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        one = found.select(F.col("__query").alias(query_key), F.col(key).cast(kinds[key]).alias(key), "similarity", "rank")
        out = one if out is None else out.unionByName(one)
    return out


def _by_length(vectors: list[list[float]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Unit query vectors by their number of coordinates, with their places."""
    out = {}
    for n in {len(v) for v in vectors}:
        at = np.array([i for i, v in enumerate(vectors) if len(v) == n])
        m = np.array([vectors[i] for i in at], np.float64).reshape(len(at), n)
        length = np.sqrt((m * m).sum(1, keepdims=True))
        out[n] = (at, np.divide(m, length, out=np.zeros_like(m), where=length > 0))
    return out


def _best(wanted: dict, n_queries: int, batch: pa.RecordBatch, k: int) -> pa.Table:
    """The best k of a batch for every query."""
    lists = batch.column(1)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    score = np.zeros((n_queries, batch.num_rows))
    for n, (at, q) in wanted.items():
        own = np.flatnonzero(sizes == n)
        if n and len(own):
            m = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), n)
            length = np.sqrt((m * m).sum(1))
            score[np.ix_(at, own)] = (q @ m.T) * np.divide(1.0, length, out=np.zeros_like(length), where=length > 0)
    score = np.round(score, 12)
    if batch.num_rows > k:  # all that tie with the k-th stay until keys decide
        least = np.partition(score, batch.num_rows - k, axis=1)[:, batch.num_rows - k]
        query, row = np.nonzero(score >= least[:, None])
    else:
        query, row = (x.ravel() for x in np.indices(score.shape))
    return first(pa.table({"__query": pa.array(query, pa.int64()), batch.schema.names[0]: batch.column(0).take(pa.array(row)), "similarity": pa.array(score[query, row])}), k)


def first(rows: pa.Table, k: int) -> pa.Table:
    """The first k rows of each query by similarity and key."""
    rows = rows.sort_by([("__query", "ascending"), ("similarity", "descending"), (rows.schema.names[1], "ascending")])
    query = rows.column("__query").to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(starts, np.diff([*starts, len(query)]))
    return rows.filter(pa.array(place < k))


def shard_topk(entries: DataFrame, vector: Sequence[float], k: int, *, key: str, shard: str, embedding: str = "embedding", only: Sequence | None = None) -> DataFrame:
    """Scatter-gather: the best k of each shard, then the best k of all. ``only`` names the shards to ask (partition pruning)."""
    rows = entries if only is None else entries.where(F.col(shard).isin(list(only)))
    scored = rows.withColumn("similarity", cosine_to(F.col(embedding), vector))
    local = Window.partitionBy(shard).orderBy(F.desc("similarity"), key)
    best = scored.withColumn("shard_rank", F.row_number().over(local)).where(F.col("shard_rank") <= k)
    return best.orderBy(F.desc("similarity"), key).limit(max(0, k))


def gather(spark: SparkSession, shards: Mapping[Any, Callable[[], DataFrame]], k: int, *, key: str, schema: str, score: str = "similarity") -> tuple[DataFrame, dict[Any, str]]:
    """Scatter-gather over shards that may fail: each is searched by a job of its own, whose best k rows (with ``schema``) come back; the best k of all,
    ties by key, and what went wrong with the shards that gave none. For shards of one healthy table, ``shard_topk`` does it in one plan."""
    found, failed = [], {}
    for name, search in shards.items():
        try:
            found += search().orderBy(F.desc(score), key).limit(max(0, k)).collect()
        except (PySparkException, Py4JError, OSError, ValueError) as e:
            failed[name] = f"{type(e).__name__}: {e}".splitlines()[0][:200]
    return spark.createDataFrame(found, schema).orderBy(F.desc(score), key).limit(max(0, k)), failed


def crosscheck(exact: DataFrame, index: DataFrame, query_key: str, *, key: str) -> DataFrame:
    """Exact and index top-1 of each query: ok, mismatch or skipped (one side has none), and the difference to six places."""
    a = exact.where("rank = 1").select(query_key, F.col(key).alias("exact_id"), F.col("similarity").alias("exact_similarity"))
    b = index.where("rank = 1").select(query_key, F.col(key).alias("index_id"), F.col("similarity").alias("index_similarity"))
    status = F.when(F.col("exact_id").isNull() | F.col("index_id").isNull(), "skipped").when(F.col("exact_id") == F.col("index_id"), "ok").otherwise("mismatch")
    delta = F.round(F.abs(F.col("exact_similarity") - F.col("index_similarity")), 6)
    return a.join(b, query_key, "full_outer").select(query_key, "exact_id", "index_id", status.alias("status"), delta.alias("delta"))


def check_embeddings(entries: DataFrame, dimension: int, embedding: str = "embedding") -> DataFrame:
    """One row: number of entries, of wrong dimensions, of values that are not finite. A build may go on only if the last two are 0."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return entries.agg(
        F.count("*").alias("entries"),
        F.count_if(v.isNull() | (F.size(v) != dimension)).alias("wrong_dimension"),
        F.count_if(v.isNotNull() & ~finite).alias("not_finite"),
    )
