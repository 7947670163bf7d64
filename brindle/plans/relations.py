"""Queries: filters, lifecycle rules, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import digests, manifest, relational, windows
from brindle.plans.registry import query, table
from brindle.session import shared_folder

NOW = "TIMESTAMP '1998-01-01 00:00:00'"


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#13' AND p_size IN (1, 4, 7, 30)")
def facet_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = relational.facets(table(spark, d, "part"), p_brand="Brand#13", p_container=" ")
    return relational.members(rows, "p_size", [1, 4, 7, 30, 4]).select("p_partkey", "p_brand")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice + 5000 <= 100000")
def range_containment(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("low"), (F.col("o_totalprice") + 5000).alias("high"))
    return relational.contained(rows, "low", "high", 1000, 100000).select("o_orderkey")


@query("SELECT p_partkey, p_type ILIKE '%steel%' AS substring_hit, list_contains(list_transform(string_split(p_type, ' '), lambda t: lower(t)), 'steel') AS exact_hit FROM part")
def tag_match(spark: SparkSession, d: str) -> DataFrame:
    tags = F.regexp_replace("p_type", " ", ",")
    return table(spark, d, "part").select("p_partkey", relational.tag_substring(tags, "steel").alias("substring_hit"), relational.tag_exact(tags, "steel").alias("exact_hit"))


def attachments(spark: SparkSession, d: str) -> DataFrame:
    """Orders as attachments: the customer is the user, the status letter a state, the order date the expiry."""
    s = F.col("o_orderstatus")
    k = F.col("o_orderkey")
    status = F.when(s == "F", "READY").when(s == "O", F.when(k % 2 == 0, "PARSING").otherwise("UPLOADED")).otherwise("FAILED")
    at = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select(k.alias("id"), F.lit("ATTACHMENT").alias("scope"), F.col("o_custkey").cast("string").alias("user_id"), (F.col("o_custkey") % 5).alias("session_id"), status.alias("status"), at.alias("expires_at"), (at - F.expr("INTERVAL 1 DAY")).alias("created_at"), (at - F.expr("INTERVAL 12 HOURS")).alias("updated_at"))


ATTACHMENTS = """(SELECT o_orderkey AS id, o_custkey::VARCHAR AS user_id, o_custkey % 5 AS session_id, CASE WHEN o_orderstatus = 'F' THEN 'READY' WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'PARSING' ELSE 'UPLOADED' END ELSE 'FAILED' END AS status,
    o_orderdate::TIMESTAMP AS expires_at, o_orderdate::TIMESTAMP - INTERVAL 1 DAY AS created_at, o_orderdate::TIMESTAMP - INTERVAL 12 HOUR AS updated_at FROM orders)"""


@query(f"SELECT id FROM {ATTACHMENTS} WHERE user_id = '37' AND session_id = 2 AND expires_at > TIMESTAMP '1995-01-01'")
def ttl_visible(spark: SparkSession, d: str) -> DataFrame:
    return attachments(spark, d).where(relational.visible(F.expr("TIMESTAMP '1995-01-01'"), "37", 2)).select("id")


@query(f"SELECT id, status FROM {ATTACHMENTS} WHERE expires_at <= TIMESTAMP '1996-01-01' ORDER BY expires_at, created_at, id LIMIT 25")
def expired_queue(spark: SparkSession, d: str) -> DataFrame:
    return relational.expired(attachments(spark, d), F.expr("TIMESTAMP '1996-01-01'"), 25).select("id", "status")


@query(f"""WITH a AS {ATTACHMENTS}, s0 AS (SELECT id, 0 AS stage, updated_at FROM a WHERE status IN ('UPLOADED', 'PARSING', 'INDEXING') AND expires_at > TIMESTAMP '1997-06-01' ORDER BY updated_at, id LIMIT 50),
    s1 AS (SELECT id, 1 AS stage, updated_at FROM a WHERE status = 'FAILED' AND updated_at <= TIMESTAMP '1994-01-01' ORDER BY updated_at, id LIMIT 50),
    s2 AS (SELECT id, 2 AS stage, updated_at FROM a WHERE expires_at <= TIMESTAMP '1993-01-01' ORDER BY updated_at, id LIMIT 50),
    u AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stage) AS n FROM u)
    SELECT id, stage FROM f WHERE n = 1 ORDER BY stage, updated_at, id LIMIT 50""")
def staged_budget(spark: SparkSession, d: str) -> DataFrame:
    a = attachments(spark, d)
    ts = lambda x: F.expr(f"TIMESTAMP '{x}'")
    stages = [relational.recoverable(a, ts("1997-06-01")), relational.stale(a, ts("1994-01-01"), ["FAILED"]), relational.expired(a, ts("1993-01-01"))]
    return relational.staged_budget(stages, ["updated_at", "id"], 50).select("id", "stage")


@query(f"""SELECT session_id, count(*) FILTER (WHERE n <= 5) AS accepted, count(*) FILTER (WHERE n > 5) AS refused FROM (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS n FROM {ATTACHMENTS}) GROUP BY session_id""")
def quota_check(spark: SparkSession, d: str) -> DataFrame:
    return relational.quota(attachments(spark, d)).groupBy("session_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"))


@query(f"""SELECT status, CASE status WHEN 'UPLOADED' THEN 'parse' WHEN 'PARSING' THEN 'wait' WHEN 'INDEXING' THEN 'index' WHEN 'READY' THEN 'done' WHEN 'FAILED' THEN 'retry' ELSE 'none' END AS action,
    CASE WHEN status IN ('UPLOADED', 'FAILED') THEN 'claim' WHEN status = 'PARSING' THEN 'in_progress' ELSE 'complete' END AS retry, status = 'DELETED' AS purgeable, count(*) AS n FROM {ATTACHMENTS} GROUP BY status""")
def lifecycle_states(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status")
    rows = relational.purge(attachments(spark, d))
    return rows.groupBy("status", relational.next_action(s).alias("action"), relational.retry_state(s).alias("retry"), "purgeable").agg(F.count("*").alias("n"))


@query(f"""WITH a AS {ATTACHMENTS}, t AS (SELECT id, 'UPLOADED' AS expected, 'PARSING' AS target, 1 AS attempt FROM a UNION ALL SELECT id, 'UPLOADED', 'DELETING', 2 FROM a UNION ALL SELECT id, 'READY', 'PARSING', 3 FROM a),
    f AS (SELECT t.*, a.status, status = expected AND (expected, target) IN (('UPLOADED', 'PARSING'), ('UPLOADED', 'DELETING')) AS fits FROM t JOIN a USING (id))
    SELECT target, count(*) FILTER (WHERE fits AND n = 1) AS won, count(*) AS attempts FROM (SELECT *, row_number() OVER (PARTITION BY id, fits ORDER BY attempt) AS n FROM f) GROUP BY target""")
def status_claim(spark: SparkSession, d: str) -> DataFrame:
    """Three attempts on each document; the first that finds its state wins."""
    a = attachments(spark, d)
    tries = a.select("id", F.explode(F.array(*[F.struct(F.lit(e).alias("expected"), F.lit(t).alias("target"), F.lit(n).alias("attempt")) for n, (e, t) in enumerate([("UPLOADED", "PARSING"), ("UPLOADED", "DELETING"), ("READY", "PARSING")], 1)])).alias("x")).select("id", "x.*")
    return relational.claim(a, tries).groupBy("target").agg(F.count_if("won").alias("won"), F.count("*").alias("attempts"))


@query("SELECT conv_id, turn, role FROM conversations WHERE role = 'user' ORDER BY conv_id DESC, turn DESC LIMIT 20")
def newest_turns(spark: SparkSession, d: str) -> DataFrame:
    return relational.newest(table(spark, d, "conversations"), 20, "conv_id", "turn", where=F.col("role") == "user").select("conv_id", "turn", "role")


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6""")
def recent_turns(spark: SparkSession, d: str) -> DataFrame:
    return windows.recent_turns(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", F.col("place").cast("long").alias("place"))


@query("""WITH t AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
    SELECT conv_id, count(*) AS to_summarise, max(turn) AS watermark FROM t WHERE c - 2 >= 2 AND n <= c - 2 GROUP BY conv_id""")
def summary_trigger(spark: SparkSession, d: str) -> DataFrame:
    return windows.summary_due(table(spark, d, "conversations"), "conv_id", "turn", recent=2, trigger=2)


@query("""SELECT c.conv_id, c.turn FROM conversations c LEFT JOIN (SELECT conv_id, max(turn) - 2 AS mark FROM conversations WHERE conv_id % 3 = 0 GROUP BY conv_id) s USING (conv_id) WHERE c.turn > coalesce(mark, 0)""")
def turns_after_watermark(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"))
    marks = turns.where("session_id % 3 = 0").groupBy("session_id").agg((F.max("id") - 2).alias("last_conversation_id"))
    return relational.unsummarised(turns, marks).select(F.col("session_id").alias("conv_id"), F.col("id").alias("turn"))


@query("""WITH t AS (SELECT conv_id, turn, text, length(text) + CASE WHEN turn > min(turn) OVER (PARTITION BY conv_id) THEN 2 ELSE 0 END AS size FROM conversations),
    u AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM t), v AS (SELECT *, upto <= 900 AS fits, 900 - (upto - size) - (size - length(text)) AS room FROM u),
    w AS (SELECT *, coalesce(max((NOT fits)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v)
    SELECT conv_id, turn, CASE WHEN fits THEN text ELSE substr(text, 1, (room - 3)::BIGINT) || '...' END AS used, NOT fits AS truncated FROM w WHERE before = 0 AND upto - size <= 900 AND (fits OR room > 80)""")
def budgeted_context(spark: SparkSession, d: str) -> DataFrame:
    return windows.budgeted(table(spark, d, "conversations"), "conv_id", "turn", "text", 900).select("conv_id", "turn", "used", "truncated")


@query(r"""WITH t AS (SELECT conv_id, turn, text, length(text) AS n, 24 + length(role) AS frame FROM conversations),
    u AS (SELECT *, 840 - (sum(n + frame) OVER (PARTITION BY conv_id ORDER BY turn) - n) AS room FROM t),
    v AS (SELECT *, coalesce(max((n > room OR room <= 0)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM u)
    SELECT conv_id, turn, CASE WHEN n > room THEN regexp_replace(substr(text, 1, (room - 1)::BIGINT), '\s+$', '') || '…' ELSE text END AS used, n > room AS truncated FROM v WHERE stopped = 0 AND room > 0""")
def attachment_context(spark: SparkSession, d: str) -> DataFrame:
    """A turn is a piece of evidence in a frame that names its role, below a header of 60 characters."""
    frame = F.length("role") + 24
    return windows.framed(table(spark, d, "conversations"), "conv_id", "turn", "text", frame, 900, header=60).select("conv_id", "turn", "used", "truncated")


@query(r"""WITH g AS (SELECT conv_id, count(*) AS n, '## ' || count(*) || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY turn DESC) AS f FROM conversations GROUP BY conv_id)
    SELECT conv_id, n, CASE WHEN length(f) > 400 THEN regexp_replace(substr(f, 1, 400), '\s+$', '') ELSE f END AS context FROM g""")
def private_context(spark: SparkSession, d: str) -> DataFrame:
    """All turns of a conversation, the newest first, cut as a whole."""
    head = lambda n: F.concat(F.lit("## "), n.cast("string"), F.lit("\n\n"))
    return windows.hard_cut(table(spark, d, "conversations"), "conv_id", "text", head, 400, newest="turn", key="turn")


OLD = "(SELECT doc_id, sha256(text) AS h, n_chars // 500 AS chunks FROM documents WHERE doc_id % 10 <> 3)"
NEW = "(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS h, n_chars // 700 AS chunks FROM documents WHERE doc_id % 10 <> 5)"


def versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the corpus: some documents only in one, some changed, all with fewer chunks in the second."""
    docs = table(spark, d, "documents")
    plain, marked = F.sha2("text", 256), F.sha2(F.concat("text", F.lit("!")), 256)
    old = docs.where("doc_id % 10 <> 3").select("doc_id", plain.alias("h"), F.expr("n_chars div 500").alias("chunks"))
    return old, docs.where("doc_id % 10 <> 5").select("doc_id", F.when(F.col("doc_id") % 7 == 0, marked).otherwise(plain).alias("h"), F.expr("n_chars div 700").alias("chunks"))


@query(f"""SELECT doc_id, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS change FROM {OLD} o FULL JOIN {NEW} n USING (doc_id)""")
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    return manifest.difference(*versions(spark, d), "doc_id", "h")


@query(f"""SELECT doc_id || '#' || i AS chunk_id FROM (SELECT doc_id, unnest(range(coalesce(n.chunks, 0), o.chunks)) AS i FROM {OLD} o LEFT JOIN {NEW} n USING (doc_id) WHERE coalesce(n.chunks, 0) < o.chunks)""")
def obsolete_ids(spark: SparkSession, d: str) -> DataFrame:
    return manifest.obsolete_ids(*versions(spark, d), "doc_id", "chunks")


@query(f"SELECT side, count(*) AS n FROM (SELECT CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'both' END AS side FROM {OLD} o FULL JOIN {NEW} n ON o.doc_id = n.doc_id) GROUP BY side")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    return relational.set_operations(*versions(spark, d), "doc_id").groupBy("side").agg(F.count("*").alias("n"))


@query(f"SELECT NOT EXISTS ((SELECT doc_id, h FROM {OLD} EXCEPT ALL SELECT doc_id, h FROM {NEW}) UNION ALL (SELECT doc_id, h FROM {NEW} EXCEPT ALL SELECT doc_id, h FROM {OLD})) AS equal, TRUE AS same")
def snapshot_equality(spark: SparkSession, d: str) -> DataFrame:
    old, new = versions(spark, d)
    return spark.createDataFrame([(manifest.equal(old, new, "doc_id", "h"), manifest.equal(old, old, "doc_id", "h"))], "equal boolean, same boolean")


@query(f"SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.h, o.h) AS h, coalesce(o.chunks, n.chunks) AS chunks FROM {OLD} o FULL JOIN {NEW} n USING (doc_id)")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """New rows win, but a known document keeps its number of chunks."""
    return relational.upsert(*versions(spark, d), "doc_id", keep=["chunks"])


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return rows.where("copies > 1")


@query("""WITH f AS (SELECT doc_id::VARCHAR AS k, sha256('{"doc_id":' || doc_id || ',"n_chars":' || n_chars || '}') AS h FROM documents),
    a AS (SELECT substr(sha256(k), 1, 4) AS p, sha256(string_agg(h, chr(10) ORDER BY k, h)) AS h, count(*) AS n FROM f GROUP BY 1),
    b AS (SELECT substr(p, 1, 2) AS q, sha256(string_agg(h, chr(10) ORDER BY p)) AS h, sum(n) AS n FROM a GROUP BY 1)
    SELECT sha256(string_agg(h, chr(10) ORDER BY q)) AS fingerprint, sum(n)::BIGINT AS entries FROM b""")
def manifest_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return manifest.fingerprint(table(spark, d, "documents"), "doc_id", "n_chars")


@query("SELECT doc_id::VARCHAR AS path, 'count' AS problem FROM documents WHERE doc_id % 50 = 1 UNION ALL SELECT doc_id::VARCHAR, 'hash' FROM documents WHERE doc_id % 50 = 2 UNION ALL SELECT '/' || doc_id, 'path' FROM documents WHERE doc_id % 50 = 3")
def integrity_manifest(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 50
    path = F.when(k == 3, F.concat(F.lit("/"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    files = table(spark, d, "documents").select(path.alias("path"), F.when(k == 2, "zz").otherwise(F.sha2("text", 256)).alias("content_sha256"), F.when(k == 1, -1).otherwise(1).alias("chunk_count"))
    return manifest.problems(files)


@query("""SELECT o_custkey AS user_id, min(o_orderkey) AS id FROM orders GROUP BY o_custkey""")
def default_session(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("id"))
    return windows.least_id(rows, "user_id").select("user_id", "id")


@query("""WITH w AS (SELECT DISTINCT c_custkey AS user_id, 'default' AS persona_id FROM customer), o AS (SELECT o_custkey AS user_id, min(o_orderkey) AS id FROM orders GROUP BY 1),
    j AS (SELECT w.*, o.id FROM w LEFT JOIN o USING (user_id)) SELECT user_id, coalesce(id, 900000 + row_number() OVER (PARTITION BY id IS NULL ORDER BY user_id) - 1)::BIGINT AS id, id IS NULL AS created FROM j""")
def session_upsert(spark: SparkSession, d: str) -> DataFrame:
    sessions = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.lit("default").alias("persona_id"), F.col("o_orderkey").alias("id"))
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("default").alias("persona_id"))
    return relational.get_or_create(sessions, wanted, F.expr(NOW), 900000).select("user_id", "id", "created")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id % 4 = 0 AND doc_id % 8 = 0 THEN 0 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 9 <> 0")
def journal_patch(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    changes = docs.where("doc_id % 4 = 0").select("doc_id", F.lit("xx").alias("lang"), F.when(F.col("doc_id") % 8 == 0, F.lit(0).cast("long")).alias("n_chars"))
    return relational.delete(relational.patch(docs, changes, "doc_id"), docs.where("doc_id % 9 = 0"), "doc_id")


@query("""SELECT n.n_nationkey, r.r_name, CASE WHEN r.r_regionkey IS NULL THEN 'session_missing' WHEN r.r_name <> 'ASIA' THEN 'not_owner' END AS problem FROM (SELECT *, CASE WHEN n_nationkey % 6 = 0 THEN 99 ELSE n_regionkey END AS reg FROM nation) n LEFT JOIN region r ON r.r_regionkey = n.reg""")
def attach_problems(spark: SparkSession, d: str) -> DataFrame:
    sessions = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("user_id"))
    requests = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 6 == 0, 99).otherwise(F.col("n_regionkey")).alias("session_id"), F.lit("ASIA").alias("user_id"))
    out = relational.attach_problems(requests, sessions)
    return out.join(sessions.select(F.col("id").alias("session_id"), F.col("user_id").alias("r_name")), "session_id", "left").select("n_nationkey", "r_name", "problem")


@query("SELECT count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def integrity_orphans(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "customer").where("c_custkey % 10 <> 0")
    return table(spark, d, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count("*").alias("orphans"))


@query("SELECT conv_id FROM (SELECT conv_id, min(turn) AS a, max(turn) AS b, count(*) AS n FROM conversations WHERE (conv_id + turn) % 7 <> 0 GROUP BY conv_id) WHERE a <> 0 OR b - a + 1 <> n")
def integrity_contiguous(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("(conv_id + turn) % 7 <> 0")
    return windows.not_contiguous(rows, "conv_id", "turn").select("conv_id")


@query("SELECT event_id FROM events WHERE try_cast(props AS JSON) IS NULL OR json_extract(props, '$.k') IS NULL OR value < 1")
def integrity_events(spark: SparkSession, d: str) -> DataFrame:
    bad = F.try_parse_json("props").isNull() | F.get_json_object("props", "$.k").isNull() | (F.col("value") < 1)
    return table(spark, d, "events").where(bad).select("event_id")


@query("""WITH a AS (SELECT doc_id, md5(text) AS h, lang FROM documents),
    b AS (SELECT doc_id, CASE WHEN doc_id % 97 = 5 THEN md5(h) ELSE h END AS h, lang FROM a WHERE doc_id % 89 <> 3 UNION ALL SELECT doc_id + 1000000, h, lang FROM a WHERE doc_id % 83 = 1)
    SELECT coalesce(a.doc_id, b.doc_id) AS key, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h""")
def digest_tree_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots of the documents as digest trees, compared from the root."""
    old = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"), "lang")
    new = old.where("doc_id % 89 <> 3").withColumn("h", F.when(F.col("doc_id") % 97 == 5, F.md5("h")).otherwise(F.col("h")))
    new = new.unionByName(old.where("doc_id % 83 = 1").withColumn("doc_id", F.col("doc_id") + 1000000))
    top = shared_folder(spark, "trees")
    trees = [digests.Tree.write(rows, f"{top}/{n}", "doc_id", "doc_id", "h", "lang") for n, rows in (("old", old), ("new", new))]
    return digests.difference(*trees)


@query("""WITH f AS (SELECT 'docs/' || lang || '/' || doc_id || '.md' AS path, sha256(text) AS h, length(text) // 500 + 1 AS n FROM documents WHERE lang IS NOT NULL)
    SELECT 'sha256:' || sha256('{"chunking":{"chunk_overlap":50,"chunk_size":512},"collection_name":"learning_notes","corpus":{"chunk_count":' || sum(n)::BIGINT || ',"file_count":' || count(*) || ',"files":['
    || string_agg('{"chunk_count":' || n || ',"content_sha256":"' || h || '","path":"' || path || '"}', ',' ORDER BY path) || ']},"embedding":{"dimensions":1024,"model":"m"},"schema_version":1}') AS identity FROM f""")
def manifest_identity(spark: SparkSession, d: str) -> DataFrame:
    """The fingerprint that a stored manifest of the documents would carry."""
    docs = table(spark, d, "documents").where("lang IS NOT NULL")
    files = docs.select(F.concat(F.lit("docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.sha2("text", 256).alias("content_sha256"), (F.floor(F.length("text") / 500) + 1).alias("chunk_count"))
    found = manifest.identity(files, collection_name="learning_notes", model="m", dimensions=1024, chunk_size=512, chunk_overlap=50)
    return spark.createDataFrame([(found,)], "identity string")
