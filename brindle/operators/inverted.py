"""A stored inverted index that grows by segments, and BM25 for many queries against it.

A segment holds three tables of the documents that came with it: postings by token in lists (for few terms), documents with their terms (for many queries, and to
take a document out again), and word counts. Removed documents are marks: their keys, and their words as counts to subtract. So a change costs
what has changed: added texts are read once, removed ones not at all. A changed document is one removed and one added. Beyond MOST_PARTS segments
and marks the live rows are merged into one segment, from postings, not from texts.

Where the documents are a scan of files, possibly filtered, the files' listing tells what has changed: an index is opened without reading a document,
and only new files are read. For other sources the contents are hashed in one pass. Each condition on the corpus has an index, and
statistics, of its own. Changes fill folders of their own and are made live by the record, written last. Keys are unique; null texts have no
tokens but count as documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from hashlib import sha256
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from brindle.operators import lexical, manifest, vector
from brindle.operators.spread import spread
from brindle.session import shared_folder

MOST_PARTS = 8
#: Places that scores are rounded to before they are ranked; scores equal in them tie.
PLACES = 9
#: Weights of frequent terms that a task holds as a matrix at most, terms by queries.
MATRIX = 1 << 22
#: Postings that a task groups by their token at a time.
POSTINGS = 1 << 21
#: Documents from which on a query's k-th best of one bucket is worked out first.
SAMPLED = 1 << 17


def terms_of(rows: DataFrame) -> DataFrame:
    """Rows of key, text and others as key, the others, dl, and their distinct terms in order (words, with a blank between) with counts (tf); counted where a document lies."""
    others = [c for c in rows.columns if c not in ("key", "text")]
    pattern = re.compile(lexical.TOKEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                length, words, tf = [], [], []
                for text in part.column(part.num_columns - 1).to_pylist():
                    found = " ".join(pattern.findall(text.decode("utf-8", "replace"))).lower().split()  # a term holds no letters but ASCII ones and CJK
                    bag = Counter(found)
                    terms = sorted(bag)
                    length.append(len(found))
                    words.append(" ".join(terms))
                    tf.append([bag[t] for t in terms])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(length, pa.int32()), pa.array(words, pa.string()), pa.array(tf, pa.list_(pa.int32()))], ["key", *others, "dl", "words", "tf"])

    texts = rows.select("key", *others, F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    more = [T.StructField("dl", T.IntegerType()), T.StructField("words", T.StringType()), T.StructField("tf", T.ArrayType(T.IntegerType()))]
    return texts.mapInArrow(run, T.StructType([*texts.schema[:-1], *more]))


def _lists(words: pa.Array) -> pa.Array:
    """The terms of each document; null where there are none."""
    return pc.split_pattern(pc.if_else(pc.equal(words, ""), pa.scalar(None, pa.string()), words), " ")


def postings_of(rows: DataFrame) -> DataFrame:
    """Rows of key, dl, words and tf as token with its documents' keys, dl and tf in lists: a row for each token of some POSTINGS of them, so that what is shuffled and sorted are lists."""
    kind = rows.schema["key"].dataType

    def listed(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(some).combine_chunks()
        key, dl, words, tf = (t[c].combine_chunks() for c in ("key", "dl", "words", "tf"))
        lists = _lists(words)
        terms = pc.list_flatten(lists).dictionary_encode()
        at = terms.indices.to_numpy()
        order = np.argsort(at, kind="stable")
        doc = pa.array(np.repeat(np.arange(len(key)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))[order])
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(terms.dictionary)))]).astype(np.int32))
        values = [key.take(doc), dl.take(doc), pc.list_flatten(tf).take(pa.array(order))]
        out = pa.RecordBatch.from_arrays([terms.dictionary, *[pa.ListArray.from_arrays(offsets, v) for v in values]], ["token", "keys", "dls", "tfs"])
        yield from (out.slice(i, 1 << 14) for i in range(0, out.num_rows, 1 << 14))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(pc.list_flatten(batch.column("tf")))
            if n >= POSTINGS:
                yield from listed(held)
                held, n = [], 0
        if n:
            yield from listed(held)

    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("token", T.StringType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("dls", ints), T.StructField("tfs", ints)])
    return rows.select("key", "dl", "words", "tf").mapInArrow(run, schema)


def words_of(rows: DataFrame) -> DataFrame:
    """Rows of words and tf as token, df and total: a row for each token of a batch, then of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = pc.list_flatten(_lists(batch.column("words"))).dictionary_encode()
            at, n = terms.indices.to_numpy(), len(terms.dictionary)
            total = np.bincount(at, pc.list_flatten(batch.column("tf")).to_numpy(), n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([terms.dictionary, pa.array(np.bincount(at, minlength=n)), pa.array(total)], ["token", "df", "total"])

    found = rows.select("words", "tf").mapInArrow(run, "token string, df bigint, total bigint")
    return found.groupBy("token").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


class Index:
    """The index of a corpus below ``root``; opening it brings it up to date. ``built``: whether anything had to be read for that.

    Without ``postings``, which many queries do not need, those of new segments are made when they are first asked for."""

    def __init__(self, docs: DataFrame, root: str, *, key: str, text: str = "text", buckets: int = 64, postings: bool = True):
        self.spark, self.key, self.buckets, self.eager = docs.sparkSession, key, buckets, postings
        self.kind = dict(docs.dtypes)[key]
        self._known: dict[tuple, float] = {}
        try:
            plan, files = manifest.listed(docs)
        except ValueError:
            plan, files = self._content(docs.select(key, text)), None
        mark = sha256(f"{key} {self.kind} {text} {buckets} lists {plan}".encode()).hexdigest()[:32]
        self.top = f"{root.rstrip('/')}/{mark}"
        self.record = manifest.read_commit(self.spark, f"{self.top}/current.json")
        self.built = self.record is None
        if self.record is None:
            self.record = {"segments": [], "gone": [], "files": {}, "next": 0}
            self._add(self._rows(docs, key, text, files), files or {})
        elif files is not None and files != self.record["files"]:
            self.built = True
            self._refresh(docs, key, text, files)

    def _content(self, rows: DataFrame) -> str:
        h = F.xxhash64(F.col(rows.columns[0]), F.coalesce(F.col(rows.columns[1]), F.lit("")))
        n, total, mix = rows.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit("mix"), h))).first()
        return f"{n} {total} {mix}"

    def _rows(self, docs: DataFrame, key: str, text: str, files: dict | None) -> DataFrame:
        file = F.xxhash64("_metadata.file_path") if files is not None else F.lit(0).cast("long")
        return docs.select(F.col(key).alias("key"), F.col(text).alias("text"), file.alias("file"))

    # -- changes

    def change(self, added: DataFrame | None = None, removed: DataFrame | None = None, *, text: str = "text") -> None:
        """Take documents out by their keys and put others in; an added one replaces the live one of its key."""
        rows = None if added is None else added.select(F.col(self.key).alias("key"), F.col(text).alias("text"), F.lit(0).cast("long").alias("file"))
        keys = [d.select(F.col(self.key).alias("key")) for d in (added, removed) if d is not None]
        if keys:
            self._remove(reduce(DataFrame.unionByName, keys).distinct())
        if rows is not None:
            self._add(rows, self.record["files"], by_key=True)
        else:
            self._commit()

    def _refresh(self, docs: DataFrame, key: str, text: str, files: dict[str, str]) -> None:
        """Read the files that are new or changed; take out the documents of those that are so or gone."""
        old = self.record["files"]
        new = [p for p in files if files[p] != old.get(p)]
        dead = [p for p in old if old[p] != files.get(p)]
        uri = lambda paths: [self.spark._jvm.org.apache.hadoop.fs.Path(p).toUri().toString() for p in paths]
        if len(dead) == len(old) and not any(s.get("by_key", True) for s in self.record["segments"]):
            self.record = {**self.record, "segments": [], "gone": []}  # nothing is left: no need to look what goes
        elif dead:
            marks = self.spark.createDataFrame([(p,) for p in uri(dead)], "path string").select(F.xxhash64("path").alias("file"))
            self._remove(self.documents("key", "file").join(F.broadcast(marks), "file").select("key"))
        rows = self._rows(docs.where(F.col("_metadata.file_path").isin(uri(new))), key, text, files)
        self._add(rows, files)

    def _remove(self, keys: DataFrame) -> None:
        """Mark live documents as gone. Only the buckets of their keys are read, and no postings."""
        if not self.record["segments"]:
            return
        folder = f"{self.top}/{uuid4().hex[:12]}"
        live = self.documents("key", "dl", "terms", "tf", "bucket").join(keys.withColumn("bucket", self._bucket(F.col("key"))), ["bucket", "key"], "left_semi")
        live.select("key", "dl", "terms", "tf").write.parquet(f"{folder}/documents")
        out = self._read(f"{folder}/documents", f"key {self.kind}, dl int, terms array<string>, tf array<int>")
        n, total = out.agg(F.count("*"), F.sum("dl")).first()
        if not n:
            return
        words = out.select(F.explode(F.arrays_zip("terms", "tf")).alias("x")).groupBy(F.col("x.terms").alias("token"))
        self._write(words.agg((-F.count("*")).alias("df"), (-F.sum("x.tf")).alias("total")), f"{folder}/words", "token")
        self.record = {**self.record, "gone": [*self.record["gone"], {"folder": folder, "before": self.record["next"], "n": n, "total": total}]}

    def _add(self, rows: DataFrame, files: dict[str, str], by_key: bool = False) -> None:
        folder = f"{self.top}/{uuid4().hex[:12]}"
        self._write(terms_of(spread(rows)), f"{folder}/documents", "key", by="key")
        if self.eager:
            self._postings_of(folder)
        else:
            self._write(words_of(self._read(f"{folder}/documents", "words string, tf array<int>")), f"{folder}/words", "token")
        n, total = self._read(f"{folder}/documents", "dl int").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        self._segment(folder, n, total, files, by_key)

    def _postings(self, folder: str, name: str = "postings") -> None:
        self._write(postings_of(self._read(f"{folder}/documents", f"key {self.kind}, dl int, words string, tf array<int>")), f"{folder}/{name}", "token")

    def _postings_of(self, folder: str) -> None:
        self._postings(folder)
        total = F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)
        words = self._read(f"{folder}/postings", self._posting()).groupBy("token").agg(F.sum(F.size("keys")).alias("df"), F.sum(total).alias("total"))
        self._write(words, f"{folder}/words", "token")

    def _segment(self, folder: str, n: int, total: int, files: dict[str, str], by_key: bool) -> None:
        """``by_key``: whether its documents were added as rows, so that they stay when files go."""
        at = self.record["next"]
        self.record = {"segments": [*self.record["segments"], {"folder": folder, "at": at, "n": n, "total": total, "postings": "postings" if self.eager else None, "by_key": by_key}], "gone": self.record["gone"], "files": files, "next": at + 1}
        if len(self.record["segments"]) + len(self.record["gone"]) > MOST_PARTS:
            self.merge()
        else:
            self._commit()

    def merge(self) -> None:
        """Write what is live as one segment, and leave the marks behind. Texts are not read."""
        folder = f"{self.top}/{uuid4().hex[:12]}"
        self._write(self.documents("key", "file", "dl", "words", "tf"), f"{folder}/documents", "key", by="key")
        self._postings_of(folder)
        n, total = self.size()
        self.record = {**self.record, "segments": [{"folder": folder, "at": self.record["next"], "n": n, "total": total, "by_key": any(s.get("by_key", True) for s in self.record["segments"])}], "gone": [], "next": self.record["next"] + 1}
        self._commit()

    def _commit(self) -> None:
        manifest.write_commit(self.spark, f"{self.top}/current.json", self.record)
        self._known = {}

    # -- what is stored

    def _posting(self) -> str:
        return f"token string, keys array<{self.kind}>, dls array<int>, tfs array<int>, bucket int"

    def _bucket(self, token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, path: str, *order: str, by: str = "token") -> None:
        dealt = rows.withColumn("bucket", self._bucket(F.col(by))).hint("rebalance", "bucket")
        dealt.sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(path)

    def _read(self, path: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    def _live(self, segment: dict, rows: DataFrame) -> DataFrame:
        """A segment's rows but those of documents that went after it came."""
        marks = [self._read(f"{g['folder']}/documents", f"key {self.kind}") for g in self.record["gone"] if g["before"] > segment["at"]]
        return rows.join(reduce(DataFrame.unionByName, marks).distinct(), "key", "left_anti") if marks else rows

    def _all(self, rows: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], schema)

    def documents(self, *columns: str) -> DataFrame:
        """The live documents: key, file, dl, terms, words (the terms with a blank between), tf, bucket (of the key)."""
        schema = f"key {self.kind}, file bigint, dl int, words string, tf array<int>, bucket int"
        stored = dict.fromkeys(["key", *["words" if c == "terms" else c for c in columns]])
        found = [self._live(s, self._read(f"{s['folder']}/documents", schema).select(*stored)) for s in self.record["segments"]]
        terms = F.when(F.col("words") == "", F.array().cast("array<string>")).otherwise(F.split("words", " "))
        return self._all(found, schema).select(*[terms.alias(c) if c == "terms" else c for c in columns])

    def postings(self, order: list[str]) -> DataFrame:
        """The live postings of some terms: their buckets are constants, so other folders are not opened."""
        self._complete()
        mine = F.col("bucket").isin([self._bucket(F.lit(w)) for w in order]) & F.col("token").isin(order)
        of = lambda s: self._read(f"{s['folder']}/{s.get('postings', 'postings')}", self._posting()).where(mine).select("token", F.explode(F.arrays_zip("keys", "dls", "tfs")).alias("x"))
        found = [self._live(s, of(s).select("token", F.col("x.keys").alias("key"), F.col("x.dls").alias("dl"), F.col("x.tfs").alias("tf"))) for s in self.record["segments"]]
        return self._all(found, f"token string, key {self.kind}, dl int, tf int")

    def _complete(self) -> None:
        """Make the postings that segments do not have yet, under a new name by every attempt."""
        if all(s.get("postings", True) for s in self.record["segments"]):
            return
        folders = lambda record: [x["folder"] for x in [*record["segments"], *record["gone"]]]
        now, made = manifest.read_commit(self.spark, f"{self.top}/current.json"), []
        if now and folders(now) == folders(self.record):  # another has made them meanwhile
            self.record = now
        for s in self.record["segments"]:
            if not s.get("postings", True):
                self._postings(s["folder"], name := f"postings-{uuid4().hex[:12]}")
                s = {**s, "postings": name}
            made.append(s)
        self.record = {**self.record, "segments": made}
        manifest.write_commit(self.spark, f"{self.top}/current.json", self.record)

    def words(self) -> DataFrame:
        """token, df, total, bucket in parts: a row for each segment and mark that names a token; marks count negative."""
        schema = "token string, df bigint, total bigint, bucket int"
        return self._all([self._read(f"{x['folder']}/words", schema) for x in [*self.record["segments"], *self.record["gone"]]], schema)

    def size(self) -> tuple[int, int]:
        """Live documents and tokens."""
        sums = lambda c: sum(s[c] for s in self.record["segments"]) - sum(g[c] for g in self.record["gone"])
        return sums("n"), sums("total")

    # -- as a corpus of ``lexical``

    def counts(self, order: list[str]) -> DataFrame:
        """As ``Texts.counts``, of the documents that hold any of the terms."""
        each = [F.coalesce(F.max(F.when(F.col("token") == w, F.col("tf"))), F.lit(0)).alias(f"f{i}") for i, w in enumerate(order)]
        return self.postings(order).groupBy(F.col("key").alias(self.key), "dl").agg(F.lit(0).alias("__none"), *each).drop("__none")

    def totals(self, order: list[str]) -> tuple[int, float, list[int]]:
        mine = F.col("bucket").isin([self._bucket(F.lit(w)) for w in order]) & F.col("token").isin(order)
        df = {r["token"]: r["df"] for r in self.words().where(mine).groupBy("token").agg(F.sum("df").alias("df")).collect()}  # a row a term
        n, total = self.size()
        return n, total / n if n else 0.0, [df.get(w, 0) for w in order]

    def mean_idf(self, n: int) -> float:
        if n not in self._known:
            self._known[n] = self.words().groupBy("token").agg(F.sum("df").alias("df")).where("df > 0").agg(F.avg(lexical.raw_idf(n))).first()[0] or 0.0
        return self._known[n]

    # -- many queries

    def topk_many(self, queries: DataFrame, k: int, *, query_key: str, query_text: str = "query_text", fallback: bool = False, block: int = 4096) -> DataFrame:
        """query_key, the index's key, score, rank: the k best documents of each query, ties by key, scores above 0.

        Queries go to the tasks in blocks of about ``block``, a pass over the stored documents for each. A task multiplies the frequent terms as matrices of single
        precision and adds up the others; what may be among a query's best by the error of that is scored again in double precision. Where a query's best so far beats all that
        a block of documents could reach by its frequent terms' largest weights, these are skipped for it. In a large index a query starts from its k-th best of one bucket,
        which bounds that of all. k rows a query and task are shuffled, never pairs."""
        with self._asked(queries, query_key, query_text, block) as blocks:
            found = [self._block(asked, k, fallback) for asked in blocks]
        names = {"__query": query_key, "key": self.key}
        return reduce(DataFrame.unionByName, found).withColumnsRenamed(names).select(query_key, self.key, "score", "rank")

    def _weighed(self, asked: DataFrame, fallback: bool) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray, float]:
        """Query, term and weight (idf times how often the query has the term) of a block of queries (query, t), and the mean length."""
        counts = asked.select("query", F.explode("t").alias("token")).groupBy("query", "token").agg(F.count("*").alias("w"))
        df = self.words().join(F.broadcast(counts.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")
        got = counts.join(df, "token").toArrow()  # the terms of one block of queries
        n, total = self.size()
        mean = total / n if n else 0.0
        own, w, freq = (got[c].to_numpy() for c in ("query", "w", "df"))
        token = got["token"].combine_chunks().cast(pa.string()).dictionary_encode()
        raw = np.log(n - freq + 0.5) - np.log(freq + 0.5) if len(freq) else np.zeros(0)
        if fallback:
            idf, mean = np.log(1 + (n - freq + 0.5) / (freq + 0.5)) if len(freq) else raw, max(mean, 1.0)
        else:
            idf = np.where(raw < 0, lexical.NEGATIVE_SHARE * self.mean_idf(n) if (raw < 0).any() else 0.0, raw)
        return own, token, w * idf, mean

    def ranked_pairs(self, queries: DataFrame, pairs: DataFrame, k: int, *, query_key: str, query_text: str = "query_text", fallback: bool = False, block: int = 4096) -> DataFrame:
        """As ``topk_many``, with the scores above 0 of given pairs (query_key, the index's key) from the same pass, as rows whose rank is null.

        Each block of queries goes to the tasks with its own pairs, and its rows are stored before the next one begins: no documents are shuffled, and a result that is
        read twice is worked out once. Pairs of a block are sent to the driver: give some for each query, not all."""
        folder = shared_folder(self.spark, "ranked")
        with self._asked(queries, query_key, query_text, block) as blocks:
            for i, asked in enumerate(blocks):
                own = pairs.select(F.col(query_key).cast(asked.schema["query"].dataType).alias("query"), F.col(self.key).cast(self.kind).alias("key")).join(F.broadcast(asked.select("query")), "query", "left_semi")
                found = self._block(asked, k, fallback, own).withColumnsRenamed({"__query": query_key, "key": self.key})
                found.write.parquet(f"{folder}/{i}")
        return self.spark.read.schema(found.schema).parquet(*[f"{folder}/{i}" for i in range(len(blocks))])

    @contextmanager
    def _asked(self, queries: DataFrame, query_key: str, query_text: str, block: int) -> Iterator[list[DataFrame]]:
        """The queries' tokens (query, t) in blocks. They are kept while their weights are worked out, so that queries are read and split once, whatever the blocks."""
        asked = queries.select(F.col(query_key).alias("query"), lexical.tokens(F.coalesce(query_text, F.lit(""))).alias("t")).persist()
        blocks = max(1, -(-asked.count() // block))
        try:
            yield [asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i) for i in range(blocks)]
        finally:
            asked.unpersist()

    def _block(self, asked: DataFrame, k: int, fallback: bool, pairs: DataFrame | None = None) -> DataFrame:
        """__query, key, score, rank; with pairs (query, key) also theirs, without a rank. Tasks name the queries: a join with their names would be a broadcast that
        waits for cores behind the passes of other blocks, and fails after some minutes."""
        spark = self.spark
        own, token, weight, mean = self._weighed(asked, fallback)
        names, query = np.unique(own, return_inverse=True)
        kind = asked.schema["query"].dataType
        own_names = spark.sparkContext.broadcast(named := pa.array(names.tolist(), to_arrow_type(kind)))
        shared = spark.sparkContext.broadcast((token.dictionary, token.indices.to_numpy(), query, weight, len(names), mean, k))
        given = None
        if pairs is not None:
            got = pairs.toArrow()  # of one block of queries
            at = pc.index_in(got["query"].combine_chunks(), named)
            given = spark.sparkContext.broadcast((at.drop_null().to_numpy(), got["key"].combine_chunks().filter(at.is_valid())))
        rows = self.documents("key", "dl", "words", "tf", "bucket")
        schema = T.StructType([T.StructField("__query", kind), rows.schema["key"], T.StructField("score", T.DoubleType()), T.StructField("given", T.BooleanType())])
        best = Window.partitionBy("__query", "given").orderBy(F.desc("score"), "key")

        def ranked(rows: DataFrame, bars, given=None) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                scan, kept = _Scan(*shared.value, least=bars and bars.value, given=given and given.value), None

                def told(t: pa.Table, of: bool) -> list[pa.RecordBatch]:
                    t = t.combine_chunks()
                    query, key, score = (t.column(i) for i in range(3))
                    return pa.table([own_names.value.take(query.combine_chunks()), key, score, pa.repeat(of, t.num_rows)], ["__query", "key", "score", "given"]).to_batches()

                for batch in batches:
                    lists = batch.set_column(batch.schema.get_field_index("words"), "terms", _lists(batch.column("words")))
                    kept = scan.add(lists, kept)
                    while scan.found:
                        yield from told(scan.found.pop(), True)
                kept = scan.end(kept)
                if kept is not None and kept.num_rows:
                    yield from told(kept, False)

            found = rows.drop("bucket").mapInArrow(run, schema).withColumn("rank", F.row_number().over(best))
            if given is None:
                return found.where(F.col("rank") <= k)
            return found.where(F.col("given") | (F.col("rank") <= k)).withColumn("rank", F.when(~F.col("given"), F.col("rank")))

        bars = None
        if self.size()[0] >= SAMPLED and len(names):
            least = np.zeros(len(names))
            some = rows.where("bucket = 0").repartition(spark.sparkContext.defaultParallelism)
            got = ranked(some, None).where(F.col("rank") == k).select("__query", "score").toArrow()  # a number a query
            least[pc.index_in(got["__query"].combine_chunks(), named).to_numpy()] = got["score"].to_numpy()
            bars = spark.sparkContext.broadcast(least)
        return ranked(rows, bars, given).select("__query", "key", "score", "rank")


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of ranges, one after another."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


class _Scan:
    """BM25 of a block of queries for blocks of documents; keeps what each query's best have. ``least``: what a query's k-th best of all is known to reach.
    ``given``: queries and keys of pairs to score whatever their rank."""

    def __init__(self, terms: list[str] | pa.Array, term: np.ndarray, query: np.ndarray, weight: np.ndarray, queries: int, mean: float, k: int, least: np.ndarray | None = None, given: tuple[np.ndarray, pa.Array] | None = None):
        self.queries, self.mean, self.k = queries, mean, k
        self.names = terms if isinstance(terms, pa.Array) else pa.array(terms, pa.string())
        order = np.argsort(term, kind="stable")
        self.query, self.weight = query[order].astype(np.int32), weight[order].astype(np.float64)
        self.count = np.bincount(term, minlength=len(terms))
        self.start = np.concatenate([[0], np.cumsum(self.count)])
        frequent = np.flatnonzero(self.count >= max(8, queries // 24))  # terms of many queries
        self.frequent = frequent[np.argsort(-self.count[frequent], kind="stable")[: MATRIX // max(1, queries)]]
        self.column = np.full(len(terms) + 1, -1)
        self.column[self.frequent] = np.arange(len(self.frequent))
        self.rows = np.zeros((queries, len(self.frequent)))  # a row a query, for pairs in double precision
        for j, t in enumerate(self.frequent):
            own = slice(self.start[t], self.start[t + 1])
            self.rows[self.query[own], j] = self.weight[own]
        self.matrix = np.ascontiguousarray(self.rows.T, dtype=np.float32)
        self.gain = np.maximum(self.matrix, 0)
        self.signed = bool((self.weight < 0).any())
        #: A bound of the rounding of a sum of products in single precision, by the sum of their sizes; twice that, as two such sums are compared.
        self.error = 2 * (len(self.frequent) + 64) * 2.0**-23
        self.known = np.zeros(queries) if least is None else least
        self.least = self.known  # of the best k so far
        self.step = max(32, min(512, vector.CELLS // max(1, queries)))
        self.waiting: list[pa.Table] = []
        self.skipped = 0
        self.given: pa.Array | None = None  # keys of given pairs
        #: Scores of the given pairs whose documents have come.
        self.found: list[pa.Table] = []
        if given is not None and len(given[0]):
            keys = given[1].dictionary_encode()
            at = keys.indices.to_numpy()
            self.given, self.given_query = keys.dictionary, given[0][np.argsort(at, kind="stable")]
            self.given_start = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(keys.dictionary)))])
            cell = query.astype(np.int64) * len(terms) + term
            by = np.argsort(cell)
            self.cell, self.cell_weight = cell[by], weight[by].astype(np.float64)

    def add(self, b: pa.RecordBatch, kept: pa.Table | None) -> pa.Table | None:
        lists, n = b.column("terms"), b.num_rows
        term = pc.fill_null(pc.index_in(pc.list_flatten(lists), self.names), -1).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        known = term >= 0
        term, doc, f = term[known], doc[known], pc.list_flatten(b.column("tf")).to_numpy(zero_copy_only=False)[known].astype(np.float64)
        share = lexical.K1 * (1 - lexical.B + lexical.B * b.column("dl").to_numpy() / self.mean) if self.mean else np.full(n, lexical.K1)
        part = f * (lexical.K1 + 1) / (f + share[doc])
        if self.given is not None:
            self._pairs(b.column("key"), term, doc, part)
        for at in range(0, n, self.step):
            few = min(self.step, n - at)
            a, z = np.searchsorted(doc, [at, at + few])
            q, r, score = self._hits(few, term[a:z], doc[a:z] - at, part[a:z])
            if len(q):
                self.waiting.append(pa.table({"__query": pa.array(q.astype(np.int64)), "key": b.column("key").take(pa.array(r + at)), "similarity": pa.array(score)}))
            if sum(t.num_rows for t in self.waiting) > (0 if kept is None else kept.num_rows // 2):
                kept = self.end(kept)
        return kept

    def end(self, kept: pa.Table | None) -> pa.Table | None:
        """The best with those that wait to be merged with them."""
        if not self.waiting:
            return kept
        kept, self.waiting = vector.first(pa.concat_tables([*([] if kept is None else [kept]), *self.waiting]), self.k), []
        query, value = kept["__query"].to_numpy(), kept["similarity"].to_numpy()
        full = np.bincount(query, minlength=self.queries) >= self.k
        least = np.full(self.queries, np.inf)
        np.minimum.at(least, query, value)
        self.least = np.maximum(self.known, np.where(full, least, 0.0))
        return kept

    def _pairs(self, keys: pa.Array, term: np.ndarray, doc: np.ndarray, part: np.ndarray) -> None:
        """Scores of the given pairs of these documents: their terms are looked up among the query's, some CELLS at a time."""
        at = pc.fill_null(pc.index_in(keys, self.given), -1).to_numpy(zero_copy_only=False)
        row = np.flatnonzero(at >= 0)
        times = self.given_start[at[row] + 1] - self.given_start[at[row]]
        query = self.given_query[_ranges(self.given_start[at[row]], times)]
        row = np.repeat(row, times)
        first = np.searchsorted(doc, row)
        size = np.searchsorted(doc, row, "right") - first
        ends = np.cumsum(size)
        a, done = 0, 0
        while a < len(row):
            z = max(a + 1, int(np.searchsorted(ends, done + vector.CELLS, "right")))
            pair, own = np.repeat(np.arange(z - a), size[a:z]), _ranges(first[a:z], size[a:z])
            cell = query[a:z][pair].astype(np.int64) * len(self.names) + term[own]
            place = np.minimum(np.searchsorted(self.cell, cell), len(self.cell) - 1)
            both = self.cell[place] == cell
            score = np.round(np.bincount(pair[both], part[own[both]] * self.cell_weight[place[both]], z - a), PLACES)
            good = np.flatnonzero(score > 0)
            if len(good):
                self.found.append(pa.table({"__query": pa.array(query[a:z][good], pa.int64()), "key": keys.take(pa.array(row[a:z][good])), "similarity": pa.array(score[good])}))
            a, done = z, int(ends[z - 1])

    def _rare(self, n: int, term: np.ndarray, doc: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Scores by the terms that are not in the matrix."""
        times = self.count[term]
        ends = np.cumsum(times)
        score = np.zeros(n * self.queries)
        a, done = 0, 0
        while a < len(term):
            z = max(a + 1, int(np.searchsorted(ends, done + 2 * vector.CELLS, "right")))
            each, total = times[a:z], int(ends[z - 1]) - done
            at = np.repeat((self.start[term[a:z]] - (ends[a:z] - each - done)).astype(np.int32), each)
            at += np.arange(total, dtype=np.int32)
            cell = np.repeat((doc[a:z] * self.queries).astype(np.int32), each)
            cell += self.query[at]
            score += np.bincount(cell, np.repeat(part[a:z], each) * self.weight[at], len(score))
            a, done = z, int(ends[z - 1])
        return score.reshape(n, self.queries)

    def _hits(self, n: int, term: np.ndarray, doc: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, document and score of what may be among a query's best."""
        rare = self.column[term] < 0
        score = self._rare(n, term[rare], doc[rare], part[rare])
        dense = np.zeros((n, len(self.frequent)))
        dense[doc[~rare], self.column[term[~rare]]] = part[~rare]
        top, most = score.max(0), dense.max(0).astype(np.float32)
        reach = most @ self.gain
        slack = self.error * (most @ np.abs(self.matrix) if self.signed else reach) + self.error * np.abs(top) + 1e-6
        hopeful = (top + reach > 0) & (top + reach >= self.least - slack)
        self.skipped += int((~hopeful).sum())
        own = np.flatnonzero(hopeful)
        if not len(own):
            return own, own, np.zeros(0)
        whole = 2 * len(own) > self.queries  # else the matrix of those that are left is worth its copy
        own = np.arange(self.queries) if whole else own
        rough = dense.astype(np.float32) @ (self.matrix if whole else self.matrix[:, own])
        rough += score if whole else score[:, own]
        slack = slack[own]
        bar = np.where(self.least[own] > 0, self.least[own] - slack, -slack if self.signed else np.finfo(np.float32).tiny).astype(np.float32)
        able = rough >= bar
        crowded = np.flatnonzero(np.count_nonzero(able, axis=0) > 2 * self.k)
        if len(crowded) and n > self.k:
            kth = np.partition(rough[:, crowded], n - self.k, axis=0)[n - self.k]
            able[:, crowded] &= rough[:, crowded] >= np.maximum(bar[crowded], kth - slack[crowded])
        r, q = np.divmod(np.flatnonzero(able), len(own))
        exact = score[r, own[q]]
        for at in range(0, len(r), 2048):
            some = slice(at, at + 2048)
            exact[some] += np.einsum("ij,ij->i", dense[r[some]], self.rows[own[q[some]]])
        exact = np.round(exact, PLACES)
        good = (exact > 0) & (exact >= self.least[own[q]] - 1e-6)
        return own[q[good]], r[good], exact[good]
