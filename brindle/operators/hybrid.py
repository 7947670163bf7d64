"""Hybrid fusion, parent collapse and reranking of hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators import ann, inverted, lexical, vector
from brindle.session import shared_folder

VECTOR_WEIGHT = LEXICAL_WEIGHT = 0.5
OVERFETCH = 2


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def fuse(vector_hits: DataFrame, lexical_scores: DataFrame, k: int, *, key: str | Sequence[str]) -> DataFrame:
    """Full outer union of candidates: score = max(v, v/2 + b/2) with v cut to 0..1 and b the normalised lexical score, best k, ties by key.

    vector_hits: key, similarity (already the best 2k). lexical_scores: key, score of all documents; the best 2k of them are candidates, but any
    score counts for a document the vector side found. A lexical-only hit reaches 0.5 at most."""
    keys = [key] if isinstance(key, str) else list(key)
    spark = vector_hits.sparkSession
    found = vector_hits.select(*keys, clamp01(F.col("similarity")).alias("v"))
    found = spark.createDataFrame(found.collect(), found.schema)  # 2k rows at most, as is the lead
    best = lexical_scores.where("score > 0").orderBy(F.desc("score"), *keys).limit(OVERFETCH * k)
    lead = spark.createDataFrame(best.collect(), best.schema)
    top = lead.agg(F.max("score")).first()[0] or 1.0
    of_found = lexical_scores.where("score > 0").join(F.broadcast(found.select(*keys)), keys, "left_semi")
    scored = lead.unionByName(of_found).dropDuplicates(keys).select(*keys, (F.col("score") / top).alias("bm25"))
    out = found.join(scored, keys, "full_outer")
    v, b = F.coalesce("v", F.lit(0.0)), F.coalesce("bm25", F.lit(0.0))
    out = out.select(*keys, v.alias("vector_score"), b.alias("lexical_score"), F.greatest(v, VECTOR_WEIGHT * v + LEXICAL_WEIGHT * b).alias("score"))
    return out.orderBy(F.desc("score"), *keys).limit(max(0, k))


def hybrid_topk(docs: DataFrame, entries: DataFrame, query_vector: Sequence[float], terms: Sequence[str], k: int, *, key: str, text: str = "text", where: Column | None = None, indexes: str | None = None) -> DataFrame:
    """Statistics are taken after the filter, as the vector side's candidates are. ``indexes``: a folder where lexical indexes of such parts are kept."""
    rows, points = (docs, entries) if where is None else (docs.where(where), entries.where(where))
    hits = vector.topk(points, query_vector, OVERFETCH * k, key=key).select(key, "similarity")
    corpus = rows if indexes is None else inverted.Index(rows, indexes, key=key, text=text)
    return fuse(hits, lexical.bm25_or_fallback(corpus, terms, key=key, text=text), k, key=key)


def hybrid_topk_many(corpus: inverted.Index, entries: DataFrame | ann.VectorIndex, queries: DataFrame, k: int, *, query_key: str, query_embedding: str = "query_embedding", query_text: str = "query_text") -> DataFrame:
    """``hybrid_topk`` for many queries (query_key, a vector, a text): query_key, the corpus's key, vector_score, lexical_score, score, rank.

    The vector side is searched exactly over a table of key and embedding, or by an approximate index. Queries whose terms all have no positive weight take the
    fallback's scores. Joined are the best 2k of both sides of each query, and the lexical scores of what the vector side found, from the pass that ranks. Both sides are
    stored, so each is worked out once: rows of 2k and 4k a query at most."""
    key, most = corpus.key, OVERFETCH * k
    if isinstance(entries, ann.VectorIndex):
        near = entries.topk_many(queries, most, query_key=query_key, query_embedding=query_embedding)
    else:
        near = vector.topk_many(entries, queries, most, key=key, query_key=query_key, query_embedding=query_embedding)
    near = near.select(query_key, key, clamp01(F.col("similarity")).alias("v"))
    near.write.parquet(found_near := shared_folder(near.sparkSession, "near"))
    near = near.sparkSession.read.schema(near.schema).parquet(found_near)

    def lexical_side(some: DataFrame, fallback: bool) -> DataFrame:
        scored = corpus.ranked_pairs(some, near, most, query_key=query_key, query_text=query_text, fallback=fallback)
        top = scored.where("rank = 1").select(query_key, F.col("score").alias("top"))
        return scored.groupBy(query_key, key).agg(F.max("score").alias("score")).join(top, query_key).select(query_key, key, (F.col("score") / F.col("top")).alias("b"))

    found = lexical_side(queries, False)
    silent = queries.join(found.select(query_key).distinct(), query_key, "left_anti")
    if not silent.isEmpty():
        found = found.unionByName(lexical_side(silent, True))
    v, b = F.coalesce("v", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    out = near.join(found, [query_key, key], "full_outer").select(query_key, key, v.alias("vector_score"), b.alias("lexical_score"), F.round(F.greatest(v, VECTOR_WEIGHT * v + LEXICAL_WEIGHT * b), 12).alias("score"))
    best = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def best_child(hits: DataFrame, *, parent: str, score: str = "similarity", ties: Sequence[str] = ()) -> DataFrame:
    """The best hit of each parent."""
    first = Window.partitionBy(parent).orderBy(F.desc(score), *ties)
    return hits.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def collapse(hits: DataFrame, parents: DataFrame, *, parent: str, fingerprint: str, category: str, score: str = "similarity", ties: Sequence[str] = ()) -> DataFrame:
    """Children to parents, then parents of one fingerprint to their best, with all categories that share the fingerprint. Hits without a parent go."""
    one = best_child(hits, parent=parent, score=score, ties=ties).join(parents, parent)
    one = best_child(one, parent=fingerprint, score=score, ties=[parent])
    shared = parents.groupBy(fingerprint).agg(F.sort_array(F.collect_set(category)).alias("categories"))
    return one.join(shared, fingerprint).orderBy(F.desc(score), parent)


def rerank(hits: DataFrame, scores: DataFrame, *, key: str, score: str = "similarity", first: int = 10) -> DataFrame:
    """Reorder the first ``first`` hits by (rerank score, similarity, place). hits has ``place`` (1, 2, ...); scores has key, rerank_score.

    If any of them lacks a finite score, or there is one hit only, the order stays and ``fallback_reason`` says why. Bounded by ``first``."""
    head = hits.where(F.col("place") <= first).join(scores.select(key, "rerank_score"), key, "left")
    finite = F.col("rerank_score").isNotNull() & ~F.isnan("rerank_score") & (F.abs("rerank_score") < float("inf"))
    whole = Window.partitionBy(F.lit(0))  # at most ``first`` rows
    head = head.withColumn("__bad", F.count_if(~finite).over(whole)).withColumn("__n", F.count("*").over(whole))
    reason = F.when(F.col("__n") <= 1, "too_few").when(F.col("__bad") > 0, "incomplete_scores")
    new = F.when(reason.isNull(), F.row_number().over(whole.orderBy(F.desc("rerank_score"), F.desc(score), "place"))).otherwise(F.col("place"))
    return head.withColumn("fallback_reason", reason).withColumn("new_place", new).drop("__bad", "__n")


def rerank_text(title: Column, source: Column, content: Column, most: int = 2000) -> Column:
    """Title, or the source's last path part, a line feed, the content's beginning: what a reranker is sent."""
    name = F.when(F.length(F.trim(F.coalesce(title, F.lit("")))) > 0, title).otherwise(F.element_at(F.split(source, "/"), -1))
    return F.concat(name, F.lit("\n"), F.substring(content, 1, most))


def parse_rerank(response: Column, expected: int) -> Column:
    """Scores by index from a response with ``results`` or ``output.results``; null unless the indexes are exactly 0 .. expected - 1 and all scores finite."""
    kind = "struct<results:array<struct<index:int,relevance_score:double>>,output:struct<results:array<struct<index:int,relevance_score:double>>>>"
    parsed = F.from_json(response, kind)
    results = F.coalesce(parsed["results"], parsed["output"]["results"])
    indexes = F.array_sort(F.transform(results, lambda r: r["index"]))
    wanted = F.array(*[F.lit(i) for i in range(expected)]).cast("array<int>")
    finite = F.forall(results, lambda r: r["relevance_score"].isNotNull() & ~F.isnan(r["relevance_score"]) & (F.abs(r["relevance_score"]) < float("inf")))
    return F.when((indexes == wanted) & finite, F.transform(F.array_sort(results), lambda r: r["relevance_score"]))


def unified(*parts: tuple[DataFrame, str, str]) -> DataFrame:
    """Union of collections as one: (rows with an ``id`` column, id prefix, doc_type); missing columns become null."""
    out = None
    for rows, prefix, kind in parts:
        one = rows.withColumn("id", F.concat(F.lit(f"{prefix}:"), F.col("id").cast("string"))).withColumn("doc_type", F.lit(kind))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
