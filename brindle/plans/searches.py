"""Queries: the searches of notes, jobs, children and attachments end to end, and what surrounds them: reranking, reports, refreshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators import evaluate, hybrid, manifest, pipelines, relational, sessions, store, vector, windows
from brindle.plans.registry import query, table
from brindle.plans.retrieval import _COS, MANY_SQL, QUERY_VECTOR, TERMS, bm25_sql, many_hits, query_vector
from brindle.session import shared_folder

_Q = f"(SELECT embedding FROM embeddings WHERE vec_id = {QUERY_VECTOR})"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Documents that have a vector."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return table(spark, d, "documents").join(e, "doc_id")


def _stored_entries(spark: SparkSession, d: str) -> DataFrame:
    """``_entries`` as a table of their own: a search by text passes over them several times, and each pass would join, and in large tables shuffle, all texts anew."""
    rows, folder = _entries(spark, d), shared_folder(spark, "entries")
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def _hybrid_over(corpus: str, k: int) -> str:
    """Fused scores of a corpus (doc_id, text, embedding) as ``f`` (doc_id, score), its best k."""
    return f"""docs AS ({corpus}), {bm25_sql(TERMS).replace("FROM documents", "FROM docs")},
    v AS (SELECT doc_id, greatest(0, least(1, s)) AS v FROM (SELECT doc_id, {_COS} AS s FROM docs e, {_Q} q ORDER BY s DESC, doc_id LIMIT {2 * k})),
    b AS (SELECT doc_id, score / (SELECT max(score) FROM scores) AS b FROM scores WHERE score > 0),
    c AS (SELECT doc_id FROM v UNION SELECT doc_id FROM (SELECT doc_id FROM b ORDER BY b DESC, doc_id LIMIT {2 * k})),
    f AS (SELECT doc_id, greatest(coalesce(v, 0.0), 0.5 * coalesce(v, 0.0) + 0.5 * coalesce(b, 0.0)) AS score FROM c LEFT JOIN v USING (doc_id) LEFT JOIN b USING (doc_id) ORDER BY score DESC, doc_id LIMIT {k})"""


_CORPUS = "SELECT doc_id, text, lang, source, embedding FROM documents JOIN embeddings ON vec_id = doc_id"


@query(f"""WITH {_hybrid_over(_CORPUS, 5)} SELECT source || '/' || doc_id AS source, lang AS title_path, round(score, 4) AS similarity, round_even(score * 100, 0)::INT AS match_score
    FROM f JOIN docs USING (doc_id) WHERE score >= 0.3""")
def note_search(spark: SparkSession, d: str) -> DataFrame:
    """Notes for one query by the fused score, above a threshold that cuts after the candidates."""
    rows = _stored_entries(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "embedding", F.concat_ws("/", "source", "doc_id").alias("source"), F.col("lang").alias("title_path"))
    return pipelines.search_notes(rows, query_vector(spark, d), TERMS, limit=5, threshold=0.3).drop("excerpt")


_CHILDREN = f"""SELECT doc_id || ':jd_text' AS doc_id, doc_id AS parent, 'jd_text' AS child_type, text, embedding FROM ({_CORPUS})
    UNION ALL SELECT doc_id || ':job_info', doc_id, 'job_info', lang || ' ' || source, embedding FROM ({_CORPUS}) WHERE doc_id % 3 > 0"""


def _children(entries: DataFrame) -> DataFrame:
    """Two children of each document: its text, and (but for every third) what kind it is."""
    rows = entries.withColumn("parent", F.concat(F.lit("jobs/"), F.col("doc_id").cast("string")))
    kinds = F.array(F.struct(F.lit("jd_text").alias("t"), F.col("text").alias("c")), F.struct(F.lit("job_info").alias("t"), F.concat_ws(" ", "lang", "source").alias("c")))
    rows = rows.select("doc_id", "parent", "embedding", F.explode(kinds).alias("x")).where("x.t = 'jd_text' OR doc_id % 3 > 0")
    return rows.select(F.concat_ws(":", "doc_id", "x.t").alias("child_id"), F.col("parent").alias("source"), F.col("x.t").alias("child_type"), F.col("x.c").alias("content"), "embedding", "doc_id")


def _parents(entries: DataFrame) -> DataFrame:
    k = F.col("doc_id")
    return entries.select(F.concat(F.lit("jobs/"), k.cast("string")).alias("source_path"), F.concat("lang", F.lit("/"), (k % 50).cast("string")).alias("fingerprint"), F.col("lang").alias("category"), k.alias("jd_id"), F.col("source").alias("title"), F.col("text").alias("full_markdown"), F.sha2("text", 256).alias("parent_sha256"))


@query(f"""WITH {_hybrid_over(_CHILDREN, 20)},
    h AS (SELECT parent, score, doc_id AS child_id FROM f JOIN (SELECT doc_id, parent FROM docs) USING (doc_id) WHERE score >= 0.2),
    best AS (SELECT parent, max(score) AS score FROM h GROUP BY parent),
    g AS (SELECT best.*, d.lang || '/' || (d.doc_id % 50) AS fp FROM best JOIN documents d ON d.doc_id = best.parent),
    r AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY score DESC, 'jobs/' || parent) AS n FROM g)
    SELECT 'jobs/' || parent AS source_path, round(score, 6) AS similarity, sha256(text) AS text_sha256 FROM r JOIN documents ON doc_id = parent WHERE n = 1 ORDER BY score DESC, 'jobs/' || parent LIMIT 5""")
def job_search(spark: SparkSession, d: str) -> DataFrame:
    """Children by the fused score, the best of each parent, the best parent of each fingerprint, with its checked full text."""
    entries = _stored_entries(spark, d)
    found = pipelines.search_jobs(_children(entries), _parents(entries), query_vector(spark, d), TERMS, limit=5, threshold=0.2)
    return found.select("source_path", F.round("similarity", 6).alias("similarity"), F.sha2("full_markdown", 256).alias("text_sha256"))


@query(f"""SELECT 'jobs/' || doc_id AS source, round(s, 6) AS similarity FROM (SELECT doc_id, {_COS} AS s FROM ({_CORPUS}) e, {_Q} q WHERE doc_id % 3 > 0 AND lang <> 'de' ORDER BY s DESC, doc_id || ':job_info' LIMIT 5)""")
def child_type_search(spark: SparkSession, d: str) -> DataFrame:
    rows = _children(_entries(spark, d)).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    found = pipelines.search_child_type(rows, query_vector(spark, d), "job_info", 5, F.col("lang") != "de")
    return found.select("source", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH e AS (SELECT doc_id, lang, text, CASE WHEN doc_id % 2 = 0 THEN 'jd' ELSE 'note' END AS doc_type, {_COS} AS s FROM ({_CORPUS}) e, {_Q} q ORDER BY s DESC, doc_id LIMIT 12)
    SELECT doc_id AS id, doc_type, round(s, 6) AS similarity, md5(CASE doc_type WHEN 'jd' THEN 'parent ' || text ELSE text END) AS shown FROM e WHERE s >= 0.1 AND (doc_type = 'note' OR doc_id % 5 > 0)""")
def unified_search(spark: SparkSession, d: str) -> DataFrame:
    """Notes and jobs in one collection; a job hit shows its parent's text, and none whose parent is missing."""
    rows = _entries(spark, d).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, "jd").otherwise("note").alias("doc_type"), F.col("doc_id").cast("string").alias("source"), "embedding", F.col("text").alias("content"))
    parents = rows.where("id % 5 > 0").select(F.col("source").alias("source_path"), F.concat(F.lit("parent "), F.col("content")).alias("full_markdown"))
    found = pipelines.unified_search(rows, parents, query_vector(spark, d), 12, 0.1)
    return found.select("id", "doc_type", F.round("similarity", 6).alias("similarity"), F.md5(F.col("text").cast("binary")).alias("shown"))


@query(f"""WITH c AS (SELECT doc_id, 'f' || doc_id % 9 AS document_id, doc_id // 9 AS chunk_index, text, doc_id % 4 AS page_start, doc_id % 5 AS page_end, {_COS} AS s FROM ({_CORPUS}) e, {_Q} q WHERE doc_id % 9 IN (1, 4, 7)),
    t AS (SELECT * FROM c ORDER BY s DESC, doc_id LIMIT 30)
    SELECT 'attachment_' || row_number() OVER (ORDER BY s DESC, document_id, chunk_index) AS evidence_id, document_id, chunk_index, round(s, 6) AS similarity FROM t
    WHERE page_start > 0 AND page_end >= page_start AND s >= 0.1 AND trim(text) <> '' QUALIFY row_number() OVER (ORDER BY s DESC, document_id, chunk_index) <= 5""")
def attachment_search(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of three ready documents as numbered evidence; chunks without valid pages are none."""
    k = F.col("doc_id")
    chunks = _entries(spark, d).select(k.alias("chunk_id"), F.concat(F.lit("f"), (k % 9).cast("string")).alias("document_id"), F.expr("doc_id DIV 9").alias("chunk_index"), "text", (k % 4).alias("page_start"), (k % 5).alias("page_end"), "embedding")
    states = chunks.where("chunk_id % 9 IN (1, 4, 7)").select("document_id").distinct().withColumn("state", F.lit("ok"))
    found = pipelines.search_attachments(chunks, states, query_vector(spark, d), limit=5, top_k=30, threshold=0.1)
    return found.select("evidence_id", "document_id", "chunk_index", F.round("similarity", 6).alias("similarity"))


@query("""SELECT page_id, md5(CASE WHEN page_id % 3 = 0 THEN regexp_extract(url, '[^/]*$') WHEN page_id % 3 = 1 THEN 'T ' || page_id ELSE regexp_extract(url, '[^/]*$') END || chr(10) || left(html, 2000)) AS sent FROM pages""")
def rerank_texts(spark: SparkSession, d: str) -> DataFrame:
    """What a reranker is sent of each page; titles are missing or blank in two of three."""
    title = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("T "), F.col("page_id").cast("string"))).when(F.col("page_id") % 3 == 2, "  ")
    return table(spark, d, "pages").select("page_id", F.md5(hybrid.rerank_text(title, F.col("url"), F.col("html")).cast("binary")).alias("sent"))


@query("""WITH o AS (SELECT l_orderkey, count(*) AS n, list(l_discount ORDER BY l_linenumber) AS s, list(l_linenumber ORDER BY l_linenumber) AS k FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, CASE WHEN k = [1, 2, 3] THEN array_to_string(list_transform(s, lambda x: printf('%.2f', x)), ',') END AS scores FROM o""")
def rerank_responses(spark: SparkSession, d: str) -> DataFrame:
    """Each order's lines as a reranker's response to three texts: only answers for exactly these count. Every other order nests its results."""
    one = F.struct((F.col("l_linenumber") - 1).alias("index"), F.col("l_discount").cast("double").alias("relevance_score"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(one), asc=False).alias("results"))
    flat, nested = F.to_json(F.struct("results")), F.to_json(F.struct(F.struct("results").alias("output")))
    scores = hybrid.parse_rerank(F.when(F.col("l_orderkey") % 2 == 0, flat).otherwise(nested), 3)
    return rows.select("l_orderkey", F.array_join(F.transform(scores, lambda x: F.format_string("%.2f", x)), ",").alias("scores"))


@query(f"""WITH h AS (SELECT * FROM ({MANY_SQL}) WHERE vec_id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 3),
    a AS (SELECT query_id, vec_id, label, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS before FROM h)
    SELECT query_id, vec_id, before, CASE WHEN label <> 2 THEN row_number() OVER (PARTITION BY query_id, label = 2 ORDER BY label DESC, before) END AS after FROM a""")
def rank_moves(spark: SparkSession, d: str) -> DataFrame:
    """Where each hit stands before and after a reordering by label that leaves label 2 out."""
    hits = many_hits(spark, d)
    place = lambda *by: F.row_number().over(Window.partitionBy("query_id").orderBy(*by)).cast("long")
    before = hits.withColumn("rank", place(F.desc("similarity"), "vec_id"))
    after = before.where("label <> 2").withColumn("rank", place(F.desc("label"), "rank"))
    return windows.moved(before, after, "query_id", "vec_id")


@query(f"""WITH h AS (SELECT * FROM ({MANY_SQL}) WHERE vec_id <> query_id), t AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 3),
    c AS (SELECT query_id, query_label AS g, query_label < 5 AS positive FROM h GROUP BY ALL),
    r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS n, label = query_label AS m, s FROM t),
    f AS (SELECT query_id, min(CASE WHEN m THEN n END) AS k, count(*) AS passed FROM r WHERE s >= 0.35 GROUP BY query_id),
    x AS (SELECT c.*, k, coalesce(passed, 0) AS passed FROM c LEFT JOIN f USING (query_id))
    SELECT count(*) FILTER (WHERE positive) AS positives, count(*) FILTER (WHERE NOT positive) AS negatives,
    round(coalesce(count(k) FILTER (WHERE positive) / nullif(count(*) FILTER (WHERE positive), 0), 0), 9)::DOUBLE AS recall,
    round(coalesce(sum(1.0 / k) FILTER (WHERE positive), 0) / greatest(count(*) FILTER (WHERE positive), 1), 9)::DOUBLE AS mrr,
    round(coalesce(count(*) FILTER (WHERE NOT positive AND passed = 0) / nullif(count(*) FILTER (WHERE NOT positive), 0), 0), 9)::DOUBLE AS negative_accuracy FROM x""")
def merged_report(spark: SparkSession, d: str) -> DataFrame:
    """The summary of all cases rebuilt from those of each label."""
    hits = many_hits(spark, d).withColumn("matched", F.col("label") == F.col("query_label"))
    cases = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("g"), (F.col("label") < 5).alias("positive"))
    results = evaluate.case_results(cases, hits, case="query_id", group="g", ties=["vec_id"], thresholds=[0.35])
    merged = evaluate.merged_summary(evaluate.metrics(results, "g"))
    return merged.select("positives", "negatives", *[F.round(c, 9).alias(c) for c in ("recall", "mrr", "negative_accuracy")])


@query("""WITH c AS (SELECT doc_id, list_distinct(regexp_extract_all(left(text, 40), '[A-Za-z]{3,}')) AS words FROM documents WHERE doc_id % 50 = 0),
    p AS (SELECT c.doc_id AS case_id, d.doc_id, d.lang || chr(10) || d.text AS hay, words, d.source FROM c JOIN documents d ON d.doc_id // 50 = c.doc_id // 50)
    SELECT case_id, doc_id, source IN ('src3', 'src7', 'src10') AND len(list_filter(words, lambda w: NOT contains(lower(hay), lower(w)))) = 0 AS matched FROM p""")
def hit_matching(spark: SparkSession, d: str) -> DataFrame:
    """Whether each hit is of an expected source and has all words of its case, which are those that a document of its block begins with."""
    docs = table(spark, d, "documents")
    words = F.array_distinct(F.regexp_extract_all(F.substring("text", 1, 40), F.lit("[A-Za-z]{3,}"), F.lit(0)))
    cases = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("case_id"), F.expr("doc_id DIV 50").alias("block"), words.alias("words"))
    hits = docs.withColumn("block", F.expr("doc_id DIV 50")).join(cases, "block")
    expected = F.array(F.lit("src3"), F.lit("src7"), F.lit("src10"))
    return hits.select("case_id", "doc_id", evaluate.hit_matches(F.col("source"), F.col("lang"), F.col("text"), expected, F.col("words")).alias("matched"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > (SELECT quantile_disc(event_id, 0.5) FROM events) ORDER BY event_id LIMIT 500")
def events_after(spark: SparkSession, d: str) -> DataFrame:
    """The page of events behind a mark, ascending."""
    events = table(spark, d, "events")
    mark = evaluate.nth(events, "event_id", F.ceil(F.col("n") / 2)).first()["value"]
    return relational.after(events, "event_id", mark, 500).select("event_id", "user_id", "event_type")


@query("""SELECT CASE WHEN p_partkey % 31 = 3 THEN 'added' WHEN p_partkey % 29 = 4 THEN 'changed' ELSE 'unchanged' END AS change, count(*) AS n FROM part WHERE p_partkey % 37 <> 5 GROUP BY 1
    UNION ALL SELECT 'removed', count(*) FROM part WHERE p_partkey % 37 = 5 AND p_partkey % 31 <> 3 UNION ALL SELECT 'stored', count(*) FROM part WHERE p_partkey % 37 <> 5""")
def children_refreshed(spark: SparkSession, d: str) -> DataFrame:
    """A stored index of parts brought up to date: only new and changed ones are embedded, gone ones dropped, the count verified in the same switch."""
    part, k = table(spark, d, "part"), F.col("p_partkey")
    rows = part.select(k.cast("string").alias("child_id"), F.md5(F.concat_ws("|", "p_name", "p_brand")).alias("index_sha256"), F.col("p_name").alias("content"), k)
    embed = lambda some, column: some.withColumn("embedding", F.array(F.length(column).cast("double")))  # noqa: E731  stands for a provider
    kept = store.Store(spark, shared_folder(spark, "children"), key="child_id", buckets=16)
    first = rows.where("p_partkey % 31 <> 3").withColumn("index_sha256", F.when(k % 29 == 4, "old").otherwise(F.col("index_sha256"))).drop("p_partkey")
    pipelines.refresh_children(first, kept, embed)
    counts = pipelines.refresh_children(rows.where("p_partkey % 37 <> 5").drop("p_partkey"), kept, embed)
    told = spark.createDataFrame(list(counts.items()), "change string, n long")  # four counts
    return told.unionByName(kept.read().where("size(embedding) = 1").agg(F.lit("stored").alias("change"), F.count("*").alias("n")))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 7 <> 0 UNION ALL SELECT l_orderkey, 1, sum(l_quantity) FROM lineitem WHERE l_orderkey % 7 = 0 GROUP BY l_orderkey)
    SELECT l_orderkey % 14 AS k, count(*) AS n, round(sum(l_quantity), 4)::DOUBLE AS quantity FROM t GROUP BY 1""")
def groups_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh order's lines give way to one line each; nothing of a longer group stays."""
    kept = store.Store(spark, shared_folder(spark, "groups"), key="l_orderkey", buckets=16)
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), F.col("l_quantity").cast("double").alias("l_quantity"))
    kept.rebuild(lines)
    short = lines.where("l_orderkey % 7 = 0").groupBy("l_orderkey").agg(F.lit(1).alias("l_linenumber"), F.sum("l_quantity").alias("l_quantity"))
    rows = kept.replace_groups(short, "l_orderkey")
    return rows.groupBy((F.col("l_orderkey") % 14).alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


@query("SELECT o_custkey, count(*) AS count FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that a stored table holds more than once."""
    kept = store.Store(spark, shared_folder(spark, "ids"), key="o_custkey", buckets=16)
    kept.rebuild(table(spark, d, "orders").select("o_custkey", "o_orderkey"))
    return kept.problems("o_custkey")


@query("""WITH s AS (SELECT DISTINCT conv_id FROM conversations WHERE turn = 0), t AS (SELECT c.* FROM conversations c JOIN s USING (conv_id) WHERE role = 'assistant' AND conv_id % 6 <> 1)
    SELECT conv_id, (SELECT count(*) FROM t WHERE t.conv_id = s.conv_id) AS saved, EXISTS (SELECT 1 FROM t WHERE t.conv_id = s.conv_id) AS touched FROM s""")
def saved_turns(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns saved to their sessions, which are touched; those of another user's session are left out."""
    turns, now, old = table(spark, d, "conversations"), F.expr("TIMESTAMP '1997-01-01'"), F.expr("TIMESTAMP '1996-01-01'")
    known = turns.where("turn = 0").select(F.col("conv_id").alias("id"), (F.col("conv_id") % 3).alias("user_id"), old.alias("created_at"), old.alias("updated_at")).distinct()
    new = turns.where("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), ((F.col("conv_id") + F.when(F.col("conv_id") % 6 == 1, 1).otherwise(0)) % 3).alias("user_id"), F.col("text").alias("message"), F.lit("{}").alias("reply_json"))
    none = new.withColumn("created_at", now).limit(0)
    saved, touched = sessions.save_turns(none, known, new, now)
    counts = saved.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("saved"))
    return touched.join(counts, "id", "left").select(F.col("id").alias("conv_id"), F.coalesce("saved", F.lit(0)).alias("saved"), (F.col("updated_at") > F.col("created_at")).alias("touched"))


@query("SELECT l_orderkey AS parent_id FROM lineitem GROUP BY l_orderkey HAVING list_sort(list(l_linestatus || (l_linenumber % 2))) <> ['F0', 'F1'] OR count(*) <> 2 OR bool_or(l_orderkey % 10 = 3)")
def child_manifest_problems(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose lines are not exactly the two kinds of child that are wanted, or whose ids do not begin with their parent's."""
    key = F.col("l_orderkey").cast("string")
    kids = table(spark, d, "lineitem").select("l_orderkey", key.alias("parent_id"), F.concat("l_linestatus", (F.col("l_linenumber") % 2).cast("string")).alias("child_type"), F.concat(F.when(F.col("l_orderkey") % 10 == 3, F.concat(F.lit("x"), key)).otherwise(key), F.lit(":"), F.col("l_linenumber").cast("string")).alias("child_id"))
    return manifest.child_problems(kids, ("F0", "F1")).select(F.col("parent_id").cast("long").alias("parent_id"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'general' WHEN 1 THEN CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN NULL ELSE CASE WHEN length(source) >= 3 THEN source END END
    WHEN 2 THEN 'llm' WHEN 3 THEN 'general' ELSE CASE WHEN length(source) >= 3 THEN source END END AS subject FROM documents""")
def path_subjects(spark: SparkSession, d: str) -> DataFrame:
    """The subject shard of five kinds of path."""
    k, name = F.col("doc_id") % 5, F.concat(F.col("doc_id").cast("string"), F.lit(".MD"))
    folder = F.when(F.col("lang") == "en", "en").when(F.col("lang") == "de", "ü!").otherwise(F.col("source"))
    path = F.when(k == 0, F.concat(F.lit("docs/"), name)).when(k == 1, F.concat_ws("/", F.lit("docs"), folder, name)).when(k == 2, F.concat_ws("/", F.lit("corpus"), "source", F.lit("docs"), name)).when(k == 3, F.concat_ws("/", F.lit("other"), "source", name)).otherwise(F.concat_ws("\\", F.lit("docs"), "source", name))
    return table(spark, d, "documents").select("doc_id", manifest.subject_of(path, {"en": "english"}).alias("subject"))


@query(f"""SELECT e.vec_id, e.label, round({_COS}, 6) AS similarity FROM embeddings e, {_Q} q WHERE e.label = 4 QUALIFY row_number() OVER (ORDER BY {_COS} DESC, e.vec_id) <= 8""")
def shard_by_listing(spark: SparkSession, d: str) -> DataFrame:
    """One shard of vectors, frozen beside the others and searched alone."""
    from brindle.operators import shards

    root = shared_folder(spark, "subjects")
    shards.freeze(table(spark, d, "embeddings"), root, "label")
    hits = vector.topk(shards.frozen(spark, root, [4]), query_vector(spark, d), 8, key="vec_id")
    return hits.select("vec_id", F.col("label").cast("int").alias("label"), F.round("similarity", 6).alias("similarity"))


@query("""SELECT l_orderkey, '[' || coalesce(string_agg('"' || trim(l_linestatus) || '"', ',' ORDER BY l_linenumber, l_linestatus) FILTER (WHERE l_linenumber % 3 <> 0), '') || ']' AS modes_json FROM lineitem GROUP BY l_orderkey""")
def job_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists cleaned (blank and null items go) and stored as JSON text."""
    mode = F.when(F.col("l_linenumber") % 3 == 0, F.when(F.col("l_linenumber") == 3, "  ")).otherwise(F.concat(F.lit(" "), "l_linestatus", F.lit(" ")))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", mode.alias("m")))).alias("x"))
    return sessions.job_rows(rows.select("l_orderkey", F.transform("x", lambda i: i["m"]).alias("modes")), ["modes"])


@query("""WITH t AS (SELECT p_partkey, left(regexp_replace(regexp_replace('mcp_' || p_brand || '_' || p_type, '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), 30) AS name, p_brand, p_type FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) AS n FROM t)
    SELECT p_partkey, CASE WHEN n > 1 THEN left(name, 21) || '_' || left(sha256(p_brand || ':' || p_type), 8) ELSE name END AS name FROM r""")
def tool_names(spark: SparkSession, d: str) -> DataFrame:
    """Local names of remote tools, cut to thirty characters; later ones of a name end in a hash."""
    from brindle.functions import paths

    tools = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("server"), F.col("p_type").alias("tool"))
    return paths.distinct_tool_names(tools, "p_partkey", most=30).select("p_partkey", "name")


@query("SELECT p_partkey, p_brand AS name, p_brand = 'search_attachments' AS forced FROM (SELECT p_partkey, CASE WHEN p_size = 7 THEN 'search_attachments' ELSE p_brand END AS p_brand FROM part) WHERE p_brand NOT IN ('Brand#12', 'Brand#34')")
def tools_left(spark: SparkSession, d: str) -> DataFrame:
    from brindle.operators import traces

    tools = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") == 7, "search_attachments").otherwise(F.col("p_brand")).alias("name"))
    return traces.available_tools(tools, ["Brand#12", "Brand#34"], True)


@query("""WITH f AS (SELECT page_id, url, 'docs/' || CASE page_id % 3 WHEN 0 THEN 'Read_Me' WHEN 1 THEN 'read_me' ELSE '_con' END || '/' || page_id // 3 || '.md' AS safe FROM pages),
    n AS (SELECT *, count(*) OVER (PARTITION BY lower(safe)) AS c FROM f)
    SELECT page_id, c AS collides, CASE WHEN c > 1 THEN replace(safe, '.md', '') || '--' || left(sha256(url), 8) || '.md' ELSE safe END AS target FROM n""")
def colliding_paths(spark: SparkSession, d: str) -> DataFrame:
    """Two of three paths differ in case only; the third has a reserved name. Characters no file system takes, and blanks at an end, are mended."""
    from brindle.functions import paths

    folder = F.when(F.col("page_id") % 3 == 0, "Read?Me").when(F.col("page_id") % 3 == 1, "read*me . ").otherwise("con")
    rows = table(spark, d, "pages").select("page_id", F.concat_ws("/", F.lit("docs"), folder, F.concat(F.expr("page_id DIV 3").cast("string"), F.lit(".md"))).alias("path"), F.col("url").alias("source_path"))
    return paths.distinct_paths(rows).select("page_id", F.col("collides").cast("long").alias("collides"), "target")


@query("SELECT DISTINCT 'learning_notes_' || label AS collection FROM embeddings WHERE label % 3 <> 0")
def shard_names(spark: SparkSession, d: str) -> DataFrame:
    from brindle.operators import shards
    from brindle.sources import files

    label = F.col("label").cast("string")
    rows = table(spark, d, "embeddings").select(F.when(F.col("label") % 3 == 0, F.concat(F.lit("other_"), label)).otherwise(F.concat(F.lit(shards.PREFIX), label)).alias("collection"))
    return files.collections(rows, shards.PREFIX)


@query("""SELECT CASE doc_id % 4 WHEN 1 THEN 'not_json' WHEN 2 THEN 'schema_version' WHEN 3 THEN 'fingerprint' ELSE 'ok' END AS state, count(*) AS n, sum(CASE WHEN doc_id % 4 = 0 THEN n_chars END)::BIGINT AS chunks FROM documents GROUP BY 1""")
def manifest_listing(spark: SparkSession, d: str) -> DataFrame:
    """Manifests as texts, three of four broken in another way."""
    from brindle.operators import shards

    k, n = F.col("doc_id") % 4, F.col("n_chars").cast("string")
    text = F.concat(F.lit('{"schema_version": '), F.when(k == 2, "7").otherwise("1"), F.when(k == 3, "").otherwise(', "fingerprint": "f"'), F.lit(', "chunks": '), n, F.lit(', "settings": {"model": "m"}'), F.when(k == 1, "").otherwise("}"))
    good, bad = shards.manifests(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), text.alias("text")))
    return bad.groupBy(F.col("problem").alias("state")).agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("chunks")).unionByName(good.agg(F.lit("ok").alias("state"), F.count("*").alias("n"), F.sum("chunks").alias("chunks")))


@query("SELECT doc_id, doc_id || CASE doc_id % 3 WHEN 0 THEN '.md' ELSE '.MD' END AS path FROM documents WHERE doc_id % 3 < 2")
def markdown_entries(spark: SparkSession, d: str) -> DataFrame:
    from brindle.sources import files

    ending = F.when(F.col("doc_id") % 3 == 0, ".md").when(F.col("doc_id") % 3 == 1, ".MD").otherwise(".md.bak")
    return files.entries(table(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), ending).alias("path")))


@query("""WITH c AS (SELECT c_custkey, c_name, mode FROM customer, (VALUES ('vector'), ('hybrid')) m(mode) WHERE c_custkey % 3 = 0)
    SELECT 'c' || c_custkey AS id, 'who is ' || c_name AS query, mode FROM c""")
def case_matrix(spark: SparkSession, d: str) -> DataFrame:
    """An evaluation set written and read back; its positive cases in every mode."""
    from brindle.sources import files

    top, k = shared_folder(spark, "matrix"), F.col("c_custkey")
    sources = F.when(k % 3 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "customer").select(F.concat(F.lit("c"), k.cast("string")).alias("id"), F.concat(F.lit("who is "), "c_name").alias("question"), sources.alias("expected_sources"))
    store.write_lines(rows, top)
    cases = files.select_cases(files.eval_cases(spark, top), positive_only=True)
    return files.case_modes(cases, ["vector", "hybrid"]).select("id", "query", "mode")


@query("""WITH r AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS url, left(html, 60) AS snippet, regexp_extract(url, '^https://([^/:?]+)', 1) AS domain FROM pages WHERE url LIKE 'https://%' AND page_id % 7 <> 2)
    SELECT min(page_id) AS place, url, arg_min(md5(snippet), page_id) AS snippet, min(domain) AS domain FROM r GROUP BY url""")
def web_results(spark: SparkSession, d: str) -> DataFrame:
    """Pages, every one offered twice, as search results: titled ones with a safe address, the first of each."""
    from brindle.sources import files

    k = F.col("page_id")
    raw = table(spark, d, "pages").select(k.alias("page_id"), F.when(k % 7 == 2, "  ").otherwise(F.concat(F.lit("T"), k.cast("string"))).alias("title"), F.concat(F.lit(" "), "url").alias("url"), F.col("html").alias("content"), F.lit("2024").alias("published_at"))
    raw = raw.withColumn("place", F.explode(F.array("page_id", F.col("page_id") + 100_000_000))).drop("page_id")
    return files.web_results(raw, most_chars=60).select("place", "url", F.md5(F.col("snippet").cast("binary")).alias("snippet"), "domain")


@query("SELECT true AS before, false AS after, count(*) AS n FROM part")
def index_readiness(spark: SparkSession, d: str) -> DataFrame:
    """Whether a stored index holds what its manifest lists, before and after one row of it changes."""
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("child_id"), F.md5("p_name").alias("index_sha256"))
    kept = store.Store(spark, shared_folder(spark, "ready"), key="child_id", buckets=8)
    kept.rebuild(rows)
    before = pipelines.ready(kept.read(), rows)
    one = rows.orderBy("child_id").limit(1).withColumn("index_sha256", F.lit("other"))
    kept.upsert(one, "child_id")
    return kept.read().agg(F.lit(before).alias("before"), F.lit(pipelines.ready(kept.read(), rows)).alias("after"), F.count("*").alias("n"))


_LIVE = "TIMESTAMP '1996-06-01 00:00:00'"


@query(f"""WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'UPLOADED' ELSE 'INDEXING' END AS status, o_orderdate::TIMESTAMP > {_LIVE} AS live FROM orders),
    c AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY l_orderkey)
    SELECT CASE WHEN status = 'INDEXING' AND live THEN CASE WHEN n IS NULL THEN 'FAILED' ELSE 'READY' END ELSE status END AS status, count(*) AS documents,
    sum(CASE WHEN status = 'INDEXING' AND live AND n IS NOT NULL THEN n WHEN id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS vectors FROM a LEFT JOIN c USING (id) GROUP BY 1""")
def attachments_published(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of indexing, unexpired documents replace their old ones; a document that brings none has failed."""
    from brindle.operators import attachments

    now = F.expr(_LIVE)
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "UPLOADED").otherwise("INDEXING").alias("status"), F.col("o_orderdate").cast("timestamp").alias("expires_at"), now.alias("updated_at"))
    old = docs.where("id % 2 = 0").select(F.col("id").alias("document_id"), F.lit(0).cast("long").alias("chunk"))
    chunks = table(spark, d, "lineitem").where("l_linenumber > 2").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("long").alias("chunk"))
    after, vectors = attachments.publish(docs, old, chunks, now)
    counts = vectors.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("v"))
    return after.join(counts, "id", "left").groupBy("status").agg(F.count("*").alias("documents"), F.coalesce(F.sum("v"), F.lit(0)).alias("vectors"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN ' a/b' WHEN 1 THEN '/a/b' WHEN 2 THEN 'a/../b' WHEN 3 THEN regexp_replace(url, '^[a-z]+://', '') WHEN 4 THEN 'a/b' ELSE 'parsed/' || page_id || '.json' END AS key,
      CASE WHEN page_id % 5 = 0 THEN 0 ELSE 3 END AS pages, CASE page_id % 3 WHEN 0 THEN 'INDEXING' WHEN 1 THEN 'PARTIAL' ELSE 'READY' END AS status, CASE WHEN page_id % 4 = 0 THEN ' ' ELSE 'x' END AS word FROM pages)
    SELECT page_id, CASE WHEN key IN (' a/b', '/a/b', 'a/../b') OR regexp_matches(key, '(^|/)[.]{0,2}(/|$)') THEN 'parsed_path' WHEN pages <= 0 THEN 'page_count' WHEN status = 'INDEXING' AND trim(word) = '' THEN 'parser'
    WHEN status = 'PARTIAL' AND trim(word) = '' THEN 'error_code' END AS problem FROM p""")
def parse_results_checked(spark: SparkSession, d: str) -> DataFrame:
    from brindle.operators import attachments

    k = F.col("page_id")
    key = F.when(k % 6 == 0, " a/b").when(k % 6 == 1, "/a/b").when(k % 6 == 2, "a/../b").when(k % 6 == 3, F.regexp_replace("url", "^[a-z]+://", "")).when(k % 6 == 4, "a/b").otherwise(F.concat(F.lit("parsed/"), k.cast("string"), F.lit(".json")))
    status = F.when(k % 3 == 0, "INDEXING").when(k % 3 == 1, "PARTIAL").otherwise("READY")
    word = F.when(k % 4 == 0, " ").otherwise("x")
    return table(spark, d, "pages").select("page_id", attachments.parse_problem(status, key, F.when(k % 5 == 0, 0).otherwise(3), word, word).alias("problem"))
