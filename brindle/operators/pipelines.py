"""Composed flows: building and refreshing a note index, refreshing a job index, searching both."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.operators import chunk_markdown, hybrid, manifest, relational, vector
from brindle.operators.store import Store
from brindle.session import shared_folder

Embed = Callable[[DataFrame, str], DataFrame]  # rows and the text column's name to the rows with ``embedding``


def build_notes(files: DataFrame, store: Store, embed: Embed, commit: str, settings: dict, *, size: int = chunk_markdown.SIZE, overlap: int = chunk_markdown.OVERLAP, dimension: int | None = None) -> str:
    """Bring a note index up to date with ``files`` (path, text, sha256); returns full, incremental or unchanged.

    Files with the hash of the last build are neither chunked nor embedded again; a store whose key is ``source`` rewrites only the buckets of files that changed.
    What the provider gave is written before it is checked and stored, so nothing is asked of it twice. Files without any chunk have no stored row; they are a table
    beside the commit record. That record is removed before the first change and written after the stored rows have been counted, so an interrupted build is not ready."""
    spark = store.spark
    last = manifest.read_commit(spark, commit)
    same = bool(last) and last.get("settings") == settings and isinstance(last.get("empty_files"), str) and store.exists()
    old = store.read().groupBy("source").agg(F.first("file_sha256").alias("digest"), F.count("*").cast("long").alias("chunks")) if same else None
    new = files.select(F.col("path").alias("source"), F.col("sha256").alias("digest"))
    if old is None:
        mode, wanted = "full", files
    else:
        changes = manifest.difference(old.select("source", "digest"), new, "source", "digest")
        known = spark.read.schema("source string, digest string").parquet(last["empty_files"])
        changes = changes.join(new.join(known, ["source", "digest"], "left_semi").select("source").withColumn("still_empty", F.lit(True)), "source", "left").where("still_empty IS NULL OR change <> 'added'")
        mode = manifest.mode(changes, True, store.count() == last.get("chunks"))
        wanted = files.join(changes.where("change IN ('added', 'changed')").select(F.col("source").alias("path")), "path", "left_semi") if mode == "incremental" else files
    if mode == "unchanged":
        return mode
    chunks = chunk_markdown.chunk_table(wanted, "path", "text", size, overlap).join(wanted.select(F.col("path").alias("source"), F.col("sha256").alias("file_sha256")), "source")
    rows = embed(chunks, "content")
    made = shared_folder(spark, "embedded")
    rows.write.parquet(made)
    rows = spark.read.schema(rows.schema).parquet(made)
    if dimension is not None:
        found = vector.check_embeddings(rows, dimension).first()
        if found["wrong_dimension"] or found["not_finite"]:
            raise ValueError(f"bad embeddings: {found.asDict()}")
    manifest.invalidate(spark, commit)
    if mode == "incremental":
        stored = store.replace_groups(rows, "source", changes.where("change IN ('changed', 'removed')").select("source"))
    else:
        stored = store.rebuild(rows)
    empty = f"{commit}-empty/{uuid4().hex[:12]}"
    files.select(F.col("path").alias("source"), F.col("sha256").alias("digest")).join(stored.select("source").distinct(), "source", "left_anti").write.parquet(empty)
    print_ = manifest.fingerprint(files.select("path", "sha256"), "path", "sha256").first()
    manifest.write_commit(spark, commit, {"settings": settings, "chunks": stored.count(), "fingerprint": print_["fingerprint"], "files": print_["entries"], "empty_files": empty})
    return mode


def refresh_children(children: DataFrame, store: Store, embed: Embed) -> dict[str, int]:
    """Embed and store only children whose hash is new, drop those that are gone; counts of each kind."""
    old = store.read().select("child_id", "index_sha256") if store.exists() else children.select("child_id", "index_sha256").limit(0)
    changes = manifest.difference(old, children.select("child_id", "index_sha256"), "child_id", "index_sha256").persist()
    counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
    fresh = children.join(changes.where("change IN ('added', 'changed')").select("child_id"), "child_id", "left_semi")
    if counts.keys() - {"unchanged"}:
        gone = changes.where("change = 'removed'").select("child_id")
        store.sync(embed(fresh, "content"), "child_id", remove=gone, expect=children.count())
    changes.unpersist()
    return counts


def ready(store_rows: DataFrame, manifest_rows: DataFrame, key: str = "child_id", digest: str = "index_sha256") -> bool:
    """Fail-closed: whether the index holds exactly what its manifest lists."""
    return manifest.equal(store_rows, manifest_rows, key, digest)


def shown_notes(hits: DataFrame) -> DataFrame:
    """What a note search returns of a hit."""
    return hits.select("source", "title_path", X.excerpt(F.col("content")).alias("excerpt"), F.round("similarity", 4).alias("similarity"), F.bround(F.col("similarity") * 100).cast("int").alias("match_score"))


def search_notes(entries: DataFrame, query: Sequence[float], terms: Sequence[str], *, limit: int = 3, threshold: float = 0.45, use_hybrid: bool = True, subject: str | None = None, rerank_scores: DataFrame | None = None) -> DataFrame:
    """Notes above the threshold, best first. Candidates are cut before the threshold; with rerank scores ten are taken and reordered."""
    limit = max(1, min(5, limit))
    k = 10 if rerank_scores is not None else limit
    rows = entries if subject is None else entries.where(F.col("subject") == subject)
    if use_hybrid:
        best = hybrid.hybrid_topk(rows, rows, query, terms, k, key="chunk_id", text="content").select("chunk_id", F.col("score").alias("similarity"))
        hits = rows.join(F.broadcast(best), "chunk_id")
    else:
        hits = vector.topk(rows, query, k, key="chunk_id")
    hits = vector.above(hits, threshold)
    if rerank_scores is not None:
        from pyspark.sql import Window

        hits = hits.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("similarity"), "chunk_id")))
        hits = hybrid.rerank(hits, rerank_scores, key="chunk_id").orderBy("new_place")
    else:
        hits = hits.orderBy(F.desc("similarity"), "chunk_id")
    return shown_notes(hits.limit(limit))


def search_jobs(children: DataFrame, parents: DataFrame, query: Sequence[float], terms: Sequence[str], *, limit: int = 3, threshold: float = 0.45, salary_floor: float | None = None, salary_ceiling: float | None = None, **facets: str | None) -> DataFrame:
    """Jobs: filter, hybrid candidates, threshold, best child of each parent, best parent of each fingerprint, full text checked against its hash."""
    relational.check_range(salary_floor, salary_ceiling)
    limit = max(1, min(5, limit))
    rows = relational.contained(relational.facets(children, **facets), "salary_min_k", "salary_max_k", salary_floor, salary_ceiling)
    best = hybrid.hybrid_topk(rows, rows, query, terms, max(4 * limit, 10), key="child_id", text="content").select("child_id", F.col("score").alias("similarity"))
    hits = vector.above(rows.join(F.broadcast(best), "child_id"), threshold).select("child_id", F.col("source").alias("source_path"), "similarity", "child_type")
    known = parents.select("source_path", "fingerprint", F.col("category").alias("parent_category"), "jd_id", "title", "full_markdown", "parent_sha256")
    out = hybrid.collapse(hits, known, parent="source_path", fingerprint="fingerprint", category="parent_category", ties=["child_id"])
    checked = F.when(F.sha2("full_markdown", 256) == F.col("parent_sha256"), F.col("full_markdown")).otherwise(F.raise_error(F.concat(F.lit("stale parent: "), F.col("source_path"))))
    return out.limit(limit).withColumn("full_markdown", checked)


def search_child_type(children: DataFrame, query: Sequence[float], child_type: str, k: int, where: Column | None = None) -> DataFrame:
    """One kind of child, the best of each source."""
    hits = vector.topk(children, query, max(4 * k, 20), key="child_id", where=(F.col("child_type") == child_type) & (F.lit(True) if where is None else where))
    return hybrid.best_child(hits, parent="source", ties=["child_id"]).orderBy(F.desc("similarity"), "source").limit(k)


def search_attachments(chunks: DataFrame, states: DataFrame, query: Sequence[float], *, limit: int = 5, top_k: int = 6, threshold: float = 0.45) -> DataFrame:
    """Chunks of the documents that ``states`` (document_id, state) finds ok, with ids attachment_1, ...; any other state is an error."""
    bad = states.where("state <> 'ok'").head()
    if bad:
        raise ValueError(f"{bad['state']}: {bad['document_id']}")
    ids = [r[0] for r in states.select("document_id").limit(6).collect()]
    if len(ids) > 5:
        raise ValueError("more than five documents")
    hits = vector.topk(chunks.where(F.col("document_id").isin(ids)), query, top_k, key="chunk_id")
    found = relational.eligible_evidence(hits, ids, threshold)
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("similarity"), "document_id", "chunk_index"))
    found = found.withColumn("__n", n).orderBy("__n").limit(max(1, min(5, limit)))
    return found.withColumn("evidence_id", F.concat(F.lit("attachment_"), F.col("__n").cast("string"))).drop("__n")


def unified_search(entries: DataFrame, parents: DataFrame, query: Sequence[float], k: int, threshold: float) -> DataFrame:
    """One collection of notes and jobs: job hits bring their parent's text (and go without one), notes their own."""
    hits = vector.above(vector.topk(entries, query, k, key="id"), threshold)
    full = hits.join(parents.select(F.col("source_path").alias("source"), F.col("full_markdown").alias("parent_text")), "source", "left")
    kept = full.where((F.col("doc_type") != "jd") | F.col("parent_text").isNotNull())
    return kept.select("id", "doc_type", "source", "similarity", F.when(F.col("doc_type") == "jd", F.col("parent_text")).otherwise(F.col("content")).alias("text")).orderBy(F.desc("similarity"), "id")
