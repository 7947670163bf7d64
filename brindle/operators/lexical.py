"""BM25 over an inverted view of the corpus: tokens, postings, statistics, scores."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from math import log
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.spread import spread

#: Runs of CJK ideographs stay whole; other words are ASCII letters, digits and _ + # . -
TOKEN = "[一-鿿]+|[A-Za-z0-9_+#.-]+"
K1, B, NEGATIVE_SHARE = 1.5, 0.75, 0.25


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column) -> Column:
    """Matches on the original text, each in lower case. The letters a match can hold are ASCII, so lowering those first gives the same."""
    return F.regexp_extract_all(F.translate(text, _CAPITALS, _SMALL), F.lit(TOKEN), F.lit(0))


def query_terms(text: str) -> list[str]:
    import re

    return [t.lower() for t in re.findall(TOKEN, text)]


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """token, ``key``, dl, tf: one row for each token of each document; write it once and reuse it for many queries.

    Words are counted where their document lies, a batch of documents at a time, so that nothing is shuffled to count them."""
    rows = docs.select(key, tokens(F.col(text)).alias("t")).where(F.size("t") > 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                length = pc.list_value_length(part.column(1))
                doc = pa.array(np.repeat(np.arange(part.num_rows), length.to_numpy(zero_copy_only=False)))
                n = pa.table({"doc": doc, "token": pc.list_flatten(part.column(1))}).group_by(["doc", "token"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
                doc, token, tf = (n.column(c) for c in ("doc", "token", "count_all"))
                yield from pa.table({"token": token, key: part.column(0).take(doc.combine_chunks()), "dl": length.take(doc.combine_chunks()).cast(pa.int32()), "tf": tf}).to_batches()

    return rows.mapInArrow(count, T.StructType([T.StructField("token", T.StringType()), rows.schema[key], T.StructField("dl", T.IntegerType()), T.StructField("tf", T.LongType())]))


def document_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """token, df: in how many documents each token occurs."""
    return spread(docs.select(text)).select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def length_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: n, avgdl."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.coalesce(F.col(text), F.lit(""))))).alias("avgdl"))


def _term_counts(docs: DataFrame, order: list[str], key: str, text: str) -> DataFrame:
    """key, dl and the count of each term (f0, f1, ...) in each document.

    Tokens and counts pass through one-element ``explode``s: filters on a score cannot move below those, which would work out the tokens
    again at each place where the score's formula names a count."""
    rows = spread(docs.select(key, text)).select(key, F.explode(F.array(tokens(F.coalesce(F.col(text), F.lit(""))))).alias("t"))
    counts = [(F.size("t") - F.size(F.array_remove("t", w))).alias(f"f{i}") for i, w in enumerate(order)]
    return rows.select(key, F.explode(F.array(F.struct(F.size("t").alias("dl"), *counts))).alias("s")).select(key, "s.*")


class Texts:
    """A corpus as its documents: every query reads and tokenises all of them, once for the statistics and once for the scores."""

    def __init__(self, docs: DataFrame, key: str, text: str):
        self.docs, self.key, self.text = docs, key, text

    def counts(self, order: list[str]) -> DataFrame:
        return _term_counts(self.docs, order, self.key, self.text)

    def totals(self, order: list[str]) -> tuple[int, float, list[int]]:
        """Number of documents, mean length, document frequency of each term."""
        got = self.counts(order).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"df{i}") for i in range(len(order))]).first()
        return got["n"], got["avgdl"] or 0.0, [got[f"df{i}"] or 0 for i in range(len(order))]

    def mean_idf(self, n: int) -> float:
        return document_frequency(self.docs, self.text).agg(F.avg(raw_idf(n))).first()[0] or 0.0


def raw_idf(n: int) -> Column:
    return F.ln(F.lit(n) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)


class Corpus(Protocol):
    """What scores are worked out from: ``Texts``, or a stored index (``inverted.Index``)."""

    key: str

    def counts(self, order: list[str]) -> DataFrame: ...

    def totals(self, order: list[str]) -> tuple[int, float, list[int]]: ...

    def mean_idf(self, n: int) -> float: ...


class Statistics:
    """What scoring one query needs of a corpus: number of documents, mean length, document frequency of each term, and the mean idf over the
    vocabulary, which is asked for only if a term is so common that its own idf is negative. One row a term, and at most one number, reach the driver."""

    def __init__(self, corpus: Corpus, terms: Sequence[str]):
        self.weight = Counter(terms)
        self.order = sorted(self.weight)
        self.n, self.avgdl, self.df = corpus.totals(self.order)
        self.raw = [log(self.n - d + 0.5) - log(d + 0.5) for d in self.df]
        rare = all(r >= 0 or not d for r, d in zip(self.raw, self.df, strict=True))
        self.floor = 0.0 if rare else NEGATIVE_SHARE * corpus.mean_idf(self.n)

    def idf(self, fallback: bool) -> list[float]:
        if fallback:
            return [log(1 + (self.n - d + 0.5) / (d + 0.5)) for d in self.df]
        return [self.floor if r < 0 else r for r in self.raw]


def _score(corpus: Corpus, stats: Statistics, fallback: bool) -> DataFrame:
    mean = max(stats.avgdl, 1.0) if fallback else stats.avgdl
    share = K1 * (1 - B + B * F.col("dl") / F.lit(mean)) if mean else F.lit(K1)
    total = F.lit(0.0)
    for i, (word, idf, df) in enumerate(zip(stats.order, stats.idf(fallback), stats.df, strict=True)):
        if df:
            f = F.col(f"f{i}")
            total = total + F.when(f > 0, F.lit(stats.weight[word] * idf) * f * (K1 + 1) / (f + share)).otherwise(0.0)
    return corpus.counts(stats.order).select(corpus.key, total.alias("score"))


def _corpus(docs: DataFrame | Corpus, key: str, text: str) -> Corpus:
    return Texts(docs, key, text) if isinstance(docs, DataFrame) else docs


def bm25(docs: DataFrame | Corpus, terms: Sequence[str], *, key: str, text: str = "text", fallback: bool = False) -> DataFrame:
    """key, score of all documents for one query's terms, repeats counting; from an index, of those that hold any term (others have 0).

    Okapi form: idf = ln(n - df + 0.5) - ln(df + 0.5), a negative one replaced by a quarter of the mean idf over the vocabulary. ``fallback``:
    idf = ln(1 + (n - df + 0.5) / (df + 0.5)), mean length at least 1. Without an index one pass for the statistics and one, without a shuffle, for the scores."""
    corpus = _corpus(docs, key, text)
    return _score(corpus, Statistics(corpus, terms), fallback)


def bm25_or_fallback(docs: DataFrame | Corpus, terms: Sequence[str], *, key: str, text: str = "text") -> DataFrame:
    """The Okapi scores, or the fallback's for all documents where no Okapi score is above 0."""
    corpus = _corpus(docs, key, text)
    stats = Statistics(corpus, terms)
    found = [i for i, d in zip(stats.idf(False), stats.df, strict=True) if d]
    fallback = not any(i > 0 for i in found)
    if not fallback and any(i <= 0 for i in found):
        fallback = not (_score(corpus, stats, False).agg(F.max("score")).first()[0] or 0) > 0
    return _score(corpus, stats, fallback)


def normalised(scores: DataFrame, score: str = "score") -> DataFrame:
    """Scores over their maximum; all 0 where that is 0 or less."""
    top = scores.agg(F.max(score).alias("top"))
    return scores.crossJoin(F.broadcast(top)).withColumn(score, F.when(F.col("top") > 0, F.col(score) / F.col("top")).otherwise(0.0)).drop("top")


def normalised_candidates(scores: DataFrame, k: int, *, key: str, score: str = "score") -> DataFrame:
    """The best k over their own maximum, which is that of all."""
    best = candidates(scores, k, key=key, score=score)
    return best.withColumn(score, F.col(score) / F.max(score).over(Window.partitionBy(F.lit(0))))  # k rows


def candidates(scores: DataFrame, k: int, *, key: str, score: str = "score") -> DataFrame:
    return scores.where(F.col(score) > 0).orderBy(F.desc(score), key).limit(max(0, k))
