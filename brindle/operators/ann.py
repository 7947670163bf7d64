"""An approximate index of vectors: inverted cells, product codes of the residuals, exact re-ranking.

Build: a coarse quantiser (k-means) and codebooks for the parts of what it leaves are trained on SAMPLE vectors at most, chosen by a hash of
their keys; how many cells hold REACH of the sample's near neighbours is measured and kept, since it depends on how far vectors cluster.
Every entry is then assigned to its nearest cell and coded, in one pass, and stored beside its own vector in ``buckets`` folders, sorted by
cell. Search: each query names its nearest cells (``probes``); the folders of other cells are not opened, and of the rest only the codes are read. A task
scores the codes of a cell for the queries that probe it, by table look-ups, and keeps its best ``k * rerank`` of each query; those alone meet the stored
vectors again, and cosines decide. An exact search (``exact``) reads the vectors of all cells instead, but passes over those of which no query's direction to the centre
and the farthest entry from it leave room for a hit. Entries are never paired with queries as rows, and no cell has to fit one task.

Vectors count by direction. Null vectors are no entries; vectors of another length, without length or not finite lie in a cell of their own that every query probes, and score 0.
Ties fall by key. An index of no entries finds nothing. Entries may be added later under the trained quantisers (``add``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators import manifest, vector
from brindle.operators.spread import spread

SAMPLE, CODES, MOST_CELLS = 65_536, 256, 4096
#: Share of near neighbours, among the sample, whose cells a search probes unless told otherwise.
REACH = 0.98


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k centres of the points, first drawn with a chance that grows with the distance from those drawn before; a centre that no point is
    nearest to moves to the point farthest from its own."""
    rng, k = np.random.default_rng(seed), min(k, len(points))
    centres, square = points[rng.integers(0, len(points), 1)], (points**2).sum(1)
    while len(centres) < k:
        far = np.maximum(square - 2 * _nearest(points, centres)[1], 0).astype(np.float64) + 1e-12
        more = rng.choice(len(points), min(k - len(centres), max(1, k // 16)), replace=False, p=far / far.sum())
        centres = np.concatenate([centres, points[more]])
    for _ in range(rounds):
        at, score = _nearest(points, centres)
        n = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres, dtype=np.float64)
        np.add.at(total, at, points)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres).astype(np.float32)
        if len(empty := np.flatnonzero(n == 0)):
            centres[empty] = points[np.argsort(2 * score - square)[: len(empty)]]
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the nearest centre and how near it is (product less half the centre's square)."""
    half = (centres**2).sum(1) / 2
    at, score = np.empty(len(points), np.int64), np.empty(len(points), np.float32)
    for lo in range(0, len(points), 1024):
        near = points[lo : lo + 1024] @ centres.T
        near -= half
        at[lo : lo + 1024] = near.argmax(1)
        score[lo : lo + 1024] = near.max(1)
    return at, score


def _unit(lists: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have the dimension and a length, and those as unit vectors."""
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    own = np.flatnonzero(sizes == dimension)
    m = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(own), dimension)
    length = np.sqrt((m.astype(np.float64) ** 2).sum(1))
    fine = np.isfinite(length) & (length > 0)
    return own[fine], (m[fine] / length[fine, None]).astype(np.float32)


class Quantiser:
    """Cells, and for each part of a vector the codes of what is left after its cell's centre."""

    def __init__(self, centres: np.ndarray, books: np.ndarray):
        self.centres, self.books = centres, books  # cells x dimension; parts x codes x part of the dimension

    @classmethod
    def train(cls, points: np.ndarray, cells: int, parts: int) -> Quantiser:
        width = -(-points.shape[1] // parts)
        centres = kmeans(points, cells)
        left = points - centres[_nearest(points, centres)[0]]
        return cls(centres, np.stack([kmeans(p, CODES, seed=j) for j, p in enumerate(cls._split(left, parts, width))]))

    @staticmethod
    def _split(m: np.ndarray, parts: int, width: int) -> list[np.ndarray]:
        padded = np.zeros((len(m), parts * width), np.float32)
        padded[:, : m.shape[1]] = m
        return [np.ascontiguousarray(padded[:, j * width : (j + 1) * width]) for j in range(parts)]

    def reach(self, points: np.ndarray, k: int = 10, queries: int = 256) -> int:
        """How many of a query's nearest cells hold REACH of its k nearest neighbours, on points of which the first are the queries."""
        cell, asked = _nearest(points, self.centres)[0], points[:queries]
        near = asked @ points.T
        near[np.arange(len(asked)), np.arange(len(asked))] = -2
        best = np.argpartition(-near, min(k, len(points) - 1), axis=1)[:, :k] if len(points) > k else np.tile(np.arange(len(points)), (len(asked), 1))
        order = np.argsort(-(asked @ self.centres.T - (self.centres**2).sum(1) / 2), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), axis=1)
        return int(np.quantile(np.take_along_axis(place, cell[best], axis=1), REACH)) + 1

    def encode(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each point, and a byte for each part."""
        cell, _ = _nearest(points, self.centres)
        left = self._split(points - self.centres[cell], len(self.books), self.books.shape[2])
        return cell, np.stack([_nearest(p, book)[0] for p, book in zip(left, self.books, strict=True)], axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """queries x parts x codes: what each code adds to the product with a query."""
        split = self._split(queries, len(self.books), self.books.shape[2])
        return np.stack([q @ book.T for q, book in zip(split, self.books, strict=True)], axis=1)


class VectorIndex:
    """An index stored below a folder; ``build`` makes one, ``VectorIndex(spark, root)`` opens it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.record = manifest.read_commit(spark, f"{self.root}/current.json")
        if self.record is None:
            raise ValueError(f"no index at {root}")
        self.key, self.embedding = self.record["key"], self.record["embedding"]
        self.quantiser = self._trained() if self.record["cells"] else None

    @classmethod
    def build(cls, entries: DataFrame, root: str, *, key: str, embedding: str = "embedding", cells: int | None = None, parts: int = 16, buckets: int = 64, sample: int = SAMPLE) -> VectorIndex:
        """Train on about ``sample`` entries of the commonest dimension, and store all. About twice the root of their number of cells, MOST_CELLS at most, unless given."""
        spark, root = entries.sparkSession, root.rstrip("/")
        rows = entries.where(F.col(embedding).isNotNull())
        sizes = rows.groupBy(F.size(embedding).alias("dimension")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dimension")
        n, most = rows.count(), sizes.first()
        step = max(1, (most["n"] if most else 0) // sample)
        some = rows.where((F.size(embedding) == (most["dimension"] if most else 0)) & (F.pmod(F.xxhash64(key), F.lit(step)) == 0)).select(embedding).limit(2 * sample).toArrow()
        lists = some.column(0).combine_chunks()
        points = _unit(lists, most["dimension"])[1] if n else np.zeros((0, 0), np.float32)
        model = f"{root}/model-{uuid4().hex[:12]}"
        count = probes = 0
        if len(points):
            trained = Quantiser.train(points, cells or min(MOST_CELLS, max(1, round(2 * n**0.5))), min(parts, points.shape[1]))
            count, probes = len(trained.centres), trained.reach(points)
            rows_of = [(-1, i, [float(x) for x in c]) for i, c in enumerate(trained.centres)] + [(j, i, [float(x) for x in c]) for j, book in enumerate(trained.books) for i, c in enumerate(book)]
            spark.createDataFrame(rows_of, "part int, place int, centre array<float>").coalesce(1).write.parquet(model)  # cells + parts * CODES rows
        record = {"key": key, "embedding": embedding, "model": model, "cells": count, "probes": probes, "dimension": most["dimension"] if n else 0, "buckets": min(buckets, max(1, count)), "segments": [], "schema": ""}
        manifest.write_commit(spark, f"{root}/current.json", record)
        index = cls(spark, root)
        index.add(entries)
        return index

    def _trained(self) -> Quantiser:
        rows = self.spark.read.parquet(self.record["model"]).orderBy("part", "place").collect()  # as written by ``build``
        books: dict[int, list] = {}
        for r in rows:
            books.setdefault(r["part"], []).append(r["centre"])
        return Quantiser(np.array(books.pop(-1), np.float32), np.array([books[j] for j in sorted(books)], np.float32))

    def add(self, entries: DataFrame) -> None:
        """Index more entries under the trained quantisers, as a segment of its own; their keys are new."""
        record, spark = self.record, self.spark
        shared, dimension, column, buckets = spark.sparkContext.broadcast(self.quantiser), record["dimension"], self.embedding, record["buckets"]
        rows = entries.where(F.col(column).isNotNull())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    b = batch.slice(at, 4096)
                    cell, codes = np.full(b.num_rows, -1, np.int32), [None] * b.num_rows
                    if shared.value is not None:
                        own, unit = _unit(b.column(column), dimension)
                        cell[own], found = shared.value.encode(unit)
                        for i, code in zip(own.tolist(), found, strict=True):
                            codes[i] = code.tobytes()
                    bucket = np.where(cell < 0, -1, cell % buckets).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(codes, pa.binary()), pa.array(bucket)], [*b.schema.names, "__cell", "__codes", "__bucket"])

        schema = T.StructType([*rows.schema, T.StructField("__cell", T.IntegerType()), T.StructField("__codes", T.BinaryType()), T.StructField("__bucket", T.IntegerType())])
        folder = f"{self.root}/segment-{uuid4().hex[:12]}"
        dealt = spread(rows).mapInArrow(run, schema).hint("rebalance", "__bucket").sortWithinPartitions("__bucket", "__cell")
        dealt.write.partitionBy("__bucket").parquet(folder)
        kept = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
        self.record = {**record, "segments": [*record["segments"], folder], "schema": kept}
        manifest.write_commit(spark, f"{self.root}/current.json", self.record)

    def entries(self) -> DataFrame:
        """All stored rows, with ``__cell``, ``__codes`` and the partition column ``__bucket``."""
        schema = f"{self.record['schema']}, __cell int, __codes binary, __bucket int"
        parts = [self.spark.read.schema(schema).parquet(s) for s in self.record["segments"]]
        return parts[0] if len(parts) == 1 else _union(parts)

    def probed(self, cells: Sequence[int]) -> DataFrame:
        """The stored rows of some cells, and those outside all cells; folders of other cells are not opened."""
        own = sorted({-1, *map(int, cells)})
        if len(own) > self.record["cells"]:
            return self.entries()
        buckets = sorted({-1 if c < 0 else c % self.record["buckets"] for c in own})
        return self.entries().where(F.col("__bucket").isin(buckets) & F.col("__cell").isin(own))

    def topk(self, query: Sequence[float], k: int, *, probes: int | None = None, rerank: int = 10, where: Column | None = None) -> DataFrame:
        """The k entries most similar to one vector: all their columns and ``similarity``."""
        one = self.spark.createDataFrame([(0, [float(x) for x in query])], "__one int, __vector array<double>")
        hits = self.topk_many(one, k, query_key="__one", query_embedding="__vector", probes=probes, rerank=rerank, where=where).select(self.key, "similarity")
        rows = self.probed(self._probes(self._queries([list(query)])[1], probes).ravel()) if self.quantiser else self.entries()
        return rows.drop("__cell", "__codes", "__bucket").join(F.broadcast(hits), self.key).orderBy(F.desc("similarity"), self.key)

    def _queries(self, vectors: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """Which query vectors have a direction, and these."""
        return _unit(pa.array(vectors, pa.list_(pa.float64())), self.record["dimension"])

    def _probes(self, queries: np.ndarray, probes: int | None) -> np.ndarray:
        """The cells nearest to each query: as many as given, or as the build measured."""
        score = queries @ self.quantiser.centres.T - (self.quantiser.centres**2).sum(1) / 2
        return np.argsort(-score, axis=1, kind="stable")[:, : probes or self.record["probes"]]

    def topk_many(self, queries: DataFrame, k: int, *, query_key: str, query_embedding: str = "query_embedding", probes: int | None = None, rerank: int = 10, where: Column | None = None, block: int = 2048, exact: bool = False) -> DataFrame:
        """query_key, key, similarity, rank: about the k most similar entries of each query; with ``exact`` just these. ``where``: a condition on the entries' columns, applied before ranking.

        Queries go to the tasks in blocks of about ``block`` vectors, a pass over the cells that any of them probes for each."""
        asked = queries.select(query_key, query_embedding)
        blocks = max(1, -(-asked.count() // block))
        parts = [asked.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == i) for i in range(blocks)]
        return _union([self._exact(p, k, query_key, query_embedding, where) if exact else self._block(p, k, query_key, query_embedding, probes, k * rerank, where) for p in parts])

    def _named(self, asked: DataFrame, query_key: str, query_embedding: str) -> tuple[list[list[float]], DataFrame]:
        """The vectors of one block of queries, and their numbers, keys and vectors as a table."""
        part = asked.toArrow()  # one block
        vectors = [v or [] for v in part.column(1).to_pylist()]
        named = {"__query": pa.array(range(len(vectors)), pa.int64()), query_key: part.column(0), query_embedding: pa.array(vectors, pa.list_(pa.float64()))}
        return vectors, self.spark.createDataFrame(pa.table(named)).withColumn(query_key, F.col(query_key).cast(dict(asked.dtypes)[query_key]))

    def _exact(self, asked: DataFrame, k: int, query_key: str, query_embedding: str, where: Column | None) -> DataFrame:
        key = self.key
        vectors, names = self._named(asked, query_key, query_embedding)
        rows = self.entries() if where is None else self.entries().where(where)
        shared = self.spark.sparkContext.broadcast((self.quantiser and self.quantiser.centres, vectors))
        schema = T.StructType([T.StructField("__query", T.LongType()), rows.schema[key], T.StructField("similarity", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan, kept = _Whole(*shared.value, k), None
            step = min(512, vector.rows_at_once(len(shared.value[1])))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    kept = scan.add(batch.slice(at, step), kept)
            if kept is not None and kept.num_rows:
                yield from kept.combine_chunks().to_batches()

        best = Window.partitionBy("__query").orderBy(F.desc("similarity"), key)
        found = rows.select(key, self.embedding, "__cell").mapInArrow(run, schema).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return found.join(F.broadcast(names.drop(query_embedding)), "__query").select(query_key, key, "similarity", "rank")

    def _block(self, asked: DataFrame, k: int, query_key: str, query_embedding: str, probes: int, most: int, where: Column | None) -> DataFrame:
        spark, key = self.spark, self.key
        vectors, names = self._named(asked, query_key, query_embedding)
        if self.quantiser is None:
            own, unit, cells = np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.int64)
        else:
            own, unit = self._queries(vectors)
            cells = self._probes(unit, probes)
        rows = self.probed(cells.ravel())
        rows = rows if where is None else rows.where(where)
        shared = spark.sparkContext.broadcast((self.quantiser, own, unit, cells, len(vectors)))
        schema = T.StructType([T.StructField("__query", T.LongType()), rows.schema[key], T.StructField("similarity", T.DoubleType()), rows.schema["__bucket"], rows.schema["__cell"]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan, kept = _Scan(*shared.value, most), None
            for batch in batches:
                for at in range(0, batch.num_rows, step := min(2048, vector.rows_at_once(len(shared.value[1])))):
                    new = scan.best(batch.slice(at, step))
                    kept = scan.known(new if kept is None else vector.first(pa.concat_tables([kept, new]), most))
            if kept is not None and kept.num_rows:
                yield from kept.combine_chunks().to_batches()

        found = rows.select(key, "__codes", "__bucket", "__cell").mapInArrow(run, schema)
        best = Window.partitionBy("__query").orderBy(F.desc("similarity"), key)
        found = found.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= most).drop("__n", "similarity")
        stored = self.probed(cells.ravel()).select("__bucket", "__cell", key, self.embedding)
        near = stored.join(F.broadcast(found), ["__bucket", "__cell", key])  # block * most rows, of keys alone
        exact = near.join(F.broadcast(names), "__query").select("__query", query_key, key, F.round(F.nanvl(vector.cosine(F.col(self.embedding), F.col(query_embedding)), F.lit(0.0)), 12).alias("similarity"))
        return exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(query_key, key, "similarity", "rank")


class _Scan:
    """Scores of coded entries for the queries that probe their cells."""

    def __init__(self, quantiser: Quantiser | None, own: np.ndarray, unit: np.ndarray, cells: np.ndarray, n_queries: int, most: int):
        self.own, self.most, self.n_queries = own, most, n_queries
        self.base = unit @ quantiser.centres.T if len(own) else np.zeros((0, 0), np.float32)
        self.tables = quantiser.tables(unit) if len(own) else None
        self.least = np.full(n_queries, -np.inf, np.float32)  # of the best ``most`` so far
        self.by_cell: dict[int, np.ndarray] = {}
        if len(own):
            order = np.argsort(cells.ravel().astype(np.int32), kind="stable").astype(np.int32)
            sorted_cells, who = cells.ravel()[order], order // cells.shape[1]
            starts = np.flatnonzero(np.concatenate([[True], sorted_cells[1:] != sorted_cells[:-1]]))
            self.by_cell = {int(sorted_cells[a]): who[a:b] for a, b in zip(starts, [*starts[1:], len(sorted_cells)], strict=True)}

    def best(self, b: pa.RecordBatch) -> pa.Table:
        cells, queries, rows, scores = b.column("__cell").to_numpy(), [], [], []
        for cell in np.unique(cells):
            at = np.flatnonzero(cells == cell)
            if cell < 0 or not len(self.own):
                who, score = np.arange(self.n_queries), np.zeros((self.n_queries, len(at)), np.float32)
            elif cell in self.by_cell:
                mine = self.by_cell[cell]
                codes = np.frombuffer(b"".join(b.column("__codes").take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
                score = np.repeat(self.base[mine, cell][:, None], len(at), axis=1)
                for j in range(codes.shape[1]):
                    score += self.tables[mine, j][:, codes[:, j]]
                who = self.own[mine]
            else:
                continue
            least = self.least[who]
            if len(at) > self.most:
                least = np.maximum(least, np.partition(score, len(at) - self.most, axis=1)[:, len(at) - self.most])
            q, r = np.nonzero(score >= least[:, None])
            queries.append(who[q])
            rows.append(at[r])
            scores.append(score[q, r])
        row = pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64))
        names = b.schema.names
        found = pa.table({
            "__query": pa.array(np.concatenate([*queries, np.zeros(0, np.int64)]).astype(np.int64)), names[0]: b.column(0).take(row),
            "similarity": pa.array(np.concatenate([*scores, np.zeros(0, np.float32)]).astype(np.float64)), "__bucket": b.column("__bucket").take(row), "__cell": b.column("__cell").take(row),
        })
        return vector.first(found, self.most)


    def known(self, kept: pa.Table) -> pa.Table:
        """Remember what an entry must reach to be among a query's best."""
        _least(self.least, kept, self.most)
        return kept


class _Whole:
    """Cosines of stored entries with all queries but those that no entry of the cells at hand can serve."""

    def __init__(self, centres: np.ndarray | None, vectors: list[list[float]], k: int):
        self.wanted, self.n, self.k = vector._by_length(vectors), len(vectors), k
        self.centres = None if centres is None else centres.astype(np.float64)
        self.least = np.full(self.n, -np.inf)
        own, unit = self.wanted.get(0 if centres is None else centres.shape[1], (np.zeros(0, np.int64), None))
        self.own, self.base = own, unit @ self.centres.T if len(own) and centres is not None else None

    def add(self, b: pa.RecordBatch, kept: pa.Table | None) -> pa.Table | None:
        cells = b.column("__cell").to_numpy()
        for odd in (True, False):
            at = np.flatnonzero((cells < 0) == odd)
            if not len(at):
                continue
            reach = np.zeros(self.n)  # other lengths and vectors without length score 0
            if not odd and self.base is not None:
                unit = _unit(b.column(1).take(pa.array(at)), self.centres.shape[1])[1]
                far = np.sqrt(((unit - self.centres[cells[at]]) ** 2).sum(1))
                here, place = np.unique(cells[at], return_inverse=True)
                most = np.zeros(len(here))
                np.maximum.at(most, place, far)
                reach[self.own] = (self.base[:, here] + most).max(1)
            asked = np.flatnonzero(reach >= self.least - 1e-6)
            if not len(asked):
                continue
            number = np.full(self.n, -1)
            number[asked] = np.arange(len(asked))
            some = {} if odd else {n: (number[own[number[own] >= 0]], q[number[own] >= 0]) for n, (own, q) in self.wanted.items()}
            found = vector._best(some, len(asked), b.take(pa.array(at)), self.k)
            found = found.set_column(0, "__query", pa.array(asked[found["__query"].to_numpy()]))
            kept = vector.first(found if kept is None else pa.concat_tables([kept, found]), self.k)
            _least(self.least, kept, self.k)
        return kept


def _least(least: np.ndarray, kept: pa.Table, most: int) -> None:
    """Set the least similarity of each query that has its best ``most``."""
    query = kept["__query"].to_numpy()
    low = np.full(len(least), np.inf)
    np.minimum.at(low, query, kept["similarity"].to_numpy())
    full = np.bincount(query, minlength=len(least)) >= most
    least[full] = low[full]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def recall(exact: DataFrame, found: DataFrame, *, query_key: str, key: str) -> float:
    """Share of the exact hits that were found."""
    n, hit = exact.join(found.select(query_key, key, F.lit(1).alias("__hit")), [query_key, key], "left").agg(F.count("*"), F.count("__hit")).first()
    return hit / n if n else 1.0
