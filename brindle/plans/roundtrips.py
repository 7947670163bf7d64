"""Queries: text forms over whole tables, and sources, sinks and stores by a round trip through files in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.operators import commits, relational, store
from brindle.operators.spread import spread
from brindle.plans.registry import query, table
from brindle.session import shared_folder
from brindle.sources import files


@query(r"""SELECT doc_id, md5(regexp_replace(one, ' +([,.;:!?，。；：！？、])', '\1', 'g')) AS normal, md5(replace(one, '|', '\|')) AS cell,
    md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS lines,
    md5(regexp_replace('```py' || chr(10) || text || chr(10) || '```' || chr(10), '(?m)^\s*```.*$\n?', '', 'g')) AS bare
    FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS one FROM documents)""")
def text_forms(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of each whole text in four normal forms."""
    t = F.col("text")
    fenced = F.concat(F.lit("```py\n"), t, F.lit("\n```\n"))
    forms = {"normal": X.normalise(t), "cell": X.table_cell(t), "lines": X.clean_lines(t), "bare": X.without_fences(fenced)}
    return table(spark, d, "documents").select("doc_id", *[F.md5(c.cast("binary")).alias(n) for n, c in forms.items()])


@query(r"""WITH k AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[,，、/|]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS k FROM documents)
    SELECT doc_id, len(k)::INT AS n, md5(array_to_string(k, '/')) AS joined FROM k""")
def keyword_lists(spark: SparkSession, d: str) -> DataFrame:
    k = X.keywords(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(k).alias("n"), F.md5(F.array_join(k, "/").cast("binary")).alias("joined"))


@query(r"""SELECT doc_id, cjk::INT AS cjk, length(regexp_replace(t, '\s', '', 'g'))::INT AS visible, floor(cjk * 1.4 + (length(t) - cjk) / 4)::INT AS estimate
    FROM (SELECT doc_id, t, length(regexp_replace(t, '[^\x{4e00}-\x{9fff}]', '', 'g')) AS cjk FROM (SELECT doc_id, text || repeat('漢字', (doc_id % 7)::BIGINT) AS t FROM documents))""")
def text_stats(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat("text", F.repeat(F.lit("漢字"), (F.col("doc_id") % 7).cast("int")))
    return table(spark, d, "documents").select("doc_id", X.cjk_count(t).alias("cjk"), X.visible_chars(t).alias("visible"), X.token_estimate(t).alias("estimate"))


@query(r"""SELECT page_id, regexp_extract(url, '[^/]*$') AS base, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(url, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda t: t <> ''), '+') AS words FROM pages""")
def name_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.basename(F.col("url")).alias("base"), F.array_join(X.name_tokens(F.col("url")), "+").alias("words"))


@query("""SELECT event_id, coalesce(try_cast(regexp_extract(props, '-?\\d+') AS INT), 0) AS n, CASE WHEN event_id % 3 = 0 THEN epoch(date_trunc('second', ts))::BIGINT - CASE WHEN event_id % 2 = 0 THEN 0 ELSE 7200 END END AS instant,
    ts + INTERVAL 36 HOUR AS expires_at, greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 50)) AS share FROM events""")
def event_values(spark: SparkSession, d: str) -> DataFrame:
    """The number in the properties, times as ISO text (with an offset in every third row, without one else), expiry and a clamped share."""
    said = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 3 != 0, "").when(F.col("event_id") % 2 == 0, "Z").otherwise("+02:00"))
    return table(spark, d, "events").select("event_id", X.first_int(F.col("props")).alias("n"), F.unix_timestamp(X.utc_instant(said)).alias("instant"), X.expires(F.col("ts"), 36).alias("expires_at"), X.clamp01(F.col("value") / 50).alias("share"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role || ' ' || conv_id ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS answer FROM conversations""")
def parsed_replies(spark: SparkSession, d: str) -> DataFrame:
    """Every third turn as a fenced JSON reply, the others as they are."""
    told = F.concat(F.lit('```json\n{"answer": "'), F.concat_ws(" ", "role", F.col("conv_id").cast("string")), F.lit('"}\n```'))
    return table(spark, d, "conversations").select("conv_id", "turn", X.parsed_reply(F.when(F.col("turn") % 3 == 0, told).otherwise(F.col("text"))).alias("answer"))


@query("SELECT doc_id, lang AS a, source AS b, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE lang END AS c FROM documents")
def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    first, second = F.create_map(F.lit("a"), "lang", F.lit("b"), "lang", F.lit("c"), "lang"), F.create_map(F.lit("b"), "source")
    third = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("c"), F.lit("new"))).otherwise(F.map_filter(second, lambda k, v: F.lit(False)))
    both = X.merged(first, second, third)
    return table(spark, d, "documents").select("doc_id", *[both[k].alias(k) for k in ("a", "b", "c")])


def _written(spark: SparkSession, rows: DataFrame, suffix: str) -> str:
    """A folder with a file for each row (name, text); the tasks write them, several a folder."""
    top = shared_folder(spark, "files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(top)
        for b in batches:
            for name, text in zip(b.column("name").to_pylist(), b.column("text").to_pylist(), strict=True):
                at = f"{root}/{name}{suffix}"
                files.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with files.open_output_stream(at) as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    rows.select("name", "text").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return top


@query("""SELECT lang || '/' || doc_id // 100 || '/' || doc_id || '.md' AS path, md5(text) AS text_md5, sha256(text) AS sha256 FROM documents WHERE lang IS NOT NULL""")
def scan_markdown(spark: SparkSession, d: str) -> DataFrame:
    """The documents as notes in folders, written by the tasks and scanned with their hashes."""
    docs = table(spark, d, "documents").where("lang IS NOT NULL")
    rows = docs.select(F.concat_ws("/", "lang", F.expr("doc_id DIV 100"), "doc_id").alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    return files.markdown(spark, _written(spark, spread(rows), ".md")).select("path", F.md5(F.col("text").cast("binary")).alias("text_md5"), "sha256")


_PAGE = "(html || '<!-- ' || page_id || ' -->')"


@query(f"SELECT 'p' || page_id % 10 || '/' || page_id || '.html' AS path, sha256({_PAGE}) AS sha256, strlen({_PAGE})::BIGINT AS size FROM pages")
def scan_html(spark: SparkSession, d: str) -> DataFrame:
    """The pages, made distinct by their numbers, with their hashes and the sizes of the listing."""
    text = F.concat("html", F.lit("<!-- "), F.col("page_id").cast("string"), F.lit(" -->"))
    rows = table(spark, d, "pages").select(F.concat(F.lit("p"), (F.col("page_id") % 10).cast("string"), F.lit("/"), F.col("page_id").cast("string")).alias("name"), text.alias("text"))
    top = _written(spark, spread(rows), ".html")
    return files.html(spark, top).select("path", "sha256").join(files.listing(spark, top, [".HTML"]).select("path", "size"), "path")


@query("""SELECT CASE WHEN c_custkey % 2 = 0 THEN 'c' || c_custkey ELSE printf('case_%03d', row_number() OVER (ORDER BY c_custkey)) END AS id, 'who is ' || c_custkey AS query,
    CASE WHEN c_custkey % 5 = 0 THEN 'five' ELSE 'default' END AS "group", CASE WHEN c_custkey % 3 = 0 THEN 'a,b' ELSE '' END AS sources FROM customer""")
def scan_cases(spark: SparkSession, d: str) -> DataFrame:
    """An evaluation set as JSON lines, read back with ids and groups filled in."""
    top, k = shared_folder(spark, "cases"), F.col("c_custkey")
    sources = F.when(k % 3 == 0, F.array(F.lit(" a"), F.lit(""), F.lit("b "))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "customer").select(F.when(k % 2 == 0, F.concat(F.lit("c"), k)).alias("id"), F.concat(F.lit(" who is "), k, F.lit(" ")).alias("query"), F.when(k % 5 == 0, "five").alias("group"), sources.alias("expected_sources"), k)
    store.write_lines(rows.repartition(1).sortWithinPartitions("c_custkey").drop("c_custkey"), top)
    return files.eval_cases(spark, top).select("id", "query", "group", F.array_join("expected_sources", ",").alias("sources"))


@query("""SELECT '{"acct":' || s_acctbal_cents || ',"key":' || s_suppkey || ',"name":"' || s_name || '","none":null}' AS value FROM (SELECT *, round(s_acctbal * 100)::BIGINT AS s_acctbal_cents FROM supplier)""")
def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    top = shared_folder(spark, "lines")
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.round(F.col("s_acctbal") * 100).cast("long").alias("acct"), F.lit(None).cast("string").alias("none"))
    store.write_lines(rows, top)
    return spark.read.text(top)


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def csv_report(spark: SparkSession, d: str) -> DataFrame:
    top = shared_folder(spark, "report")
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    store.write_report(rows, top)
    return spark.read.option("header", True).schema(rows.schema).csv(top)


@query("SELECT 3::BIGINT AS version, r_regionkey::BIGINT AS id, r_name AS name FROM region")
def seed_file(spark: SparkSession, d: str) -> DataFrame:
    top = shared_folder(spark, "seed")
    item = F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    table(spark, d, "region").agg(F.to_json(F.struct(F.lit(3).alias("version"), F.collect_list(item).alias("items"))).alias("value")).write.text(top)  # five rows
    return files.seed_items(spark, top)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 7 <> 0 AND (o_orderkey % 3 <> 0 OR o_orderkey % 4 = 0)")
def store_switches(spark: SparkSession, d: str) -> DataFrame:
    """A keyed table: rebuilt, upserted, synchronised with removals and an expected count, and deleted from."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    kept = store.Store(spark, shared_folder(spark, "store"), key="o_orderkey", buckets=8)
    kept.rebuild(orders.where("o_orderkey % 3 <> 0"))
    kept.upsert(orders.where("o_orderkey % 4 = 0").withColumn("status", F.lit("new")), "o_orderkey")
    gone = orders.where("o_orderkey % 7 = 0 AND o_orderkey % 2 = 0").select("o_orderkey")
    expect = orders.where("(o_orderkey % 3 <> 0 OR o_orderkey % 4 = 0) AND NOT (o_orderkey % 7 = 0 AND o_orderkey % 2 = 0)").count()
    kept.sync(orders.limit(0), "o_orderkey", remove=gone, expect=expect)
    kept.delete(orders.where("o_orderkey % 7 = 0").select("o_orderkey"), "o_orderkey")
    return kept.read()


@query("SELECT o_custkey, array_to_string(list_distinct_order, ',') AS seen FROM (SELECT o_custkey, list(p ORDER BY first) AS list_distinct_order FROM (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS first FROM orders GROUP BY ALL) GROUP BY o_custkey)")
def first_seen_order(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's priorities in the order of first use."""
    first = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("k"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("k", "o_orderpriority"))), lambda x: x["o_orderpriority"])  # five priorities
    return first.groupBy("o_custkey").agg(F.array_join(relational.first_seen(items), ",").alias("seen"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'bad_name' WHEN doc_id % 5 = 1 THEN 'bad_mime' WHEN length(text) = 0 THEN 'empty' WHEN strlen(text) + CASE WHEN doc_id % 5 = 2 THEN 5 ELSE 0 END > 3000 THEN 'too_large'
    WHEN doc_id % 5 = 2 THEN NULL ELSE 'bad_magic' END AS problem FROM documents""")
def upload_problems(spark: SparkSession, d: str) -> DataFrame:
    """Texts as uploads under five names and kinds; every fifth begins as a PDF does."""
    k = F.col("doc_id") % 5
    name = F.when(k == 0, "a.txt").otherwise("A.PDF")
    content = F.concat(F.when(k == 2, "%PDF-").otherwise(""), F.col("text"))
    return table(spark, d, "documents").select("doc_id", relational.file_problem(name, F.when(k == 1, "text/plain").otherwise("application/pdf"), content, 3000).alias("problem"))


@query("""WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus AS s FROM orders),
    b AS (SELECT o_orderkey, o_custkey, s, o_custkey % 3 <> 1 AND s = CASE o_custkey % 3 WHEN 0 THEN 'O' ELSE 'F' END AS won FROM a),
    c AS (SELECT o_orderkey, o_custkey, won, CASE WHEN won THEN 'C' ELSE s END AS s FROM b)
    SELECT s AS status, count(*) AS n, count(*) FILTER (WHERE won) AS first_won, count(*) FILTER (WHERE o_custkey % 2 = 0 AND s = 'C') AS second_won FROM
    (SELECT o_custkey, won, CASE WHEN o_custkey % 2 = 0 AND s = 'C' THEN 'D' ELSE s END AS t, s FROM c) GROUP BY s""")
def store_compare_and_set(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds of claims on order states, grouped by the state between them; each is applied where its order still holds what it expects."""
    kept = store.Store(spark, shared_folder(spark, "claims"), key="o_orderkey", buckets=16)
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"))
    kept.rebuild(orders)
    first = orders.where("o_custkey % 3 <> 1").select("o_orderkey", F.when(F.col("o_custkey") % 3 == 0, "O").otherwise("F").alias("expected"), F.lit("C").alias("status"))
    won = kept.compare_and_set(first, "status")
    between = kept.read().select("o_orderkey", "status")
    second = orders.where("o_custkey % 2 = 0").select("o_orderkey", F.lit("C").alias("expected"), F.lit("D").alias("status"))
    again = kept.compare_and_set(second, "status")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    rows = between.join(won.withColumnRenamed("won", "w1"), "o_orderkey", "left").join(again.withColumnRenamed("won", "w2"), "o_orderkey", "left")
    return rows.groupBy("status").agg(F.count("*").alias("n"), count(F.col("w1")).alias("first_won"), count(F.col("w2")).alias("second_won"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey % 101 DESC, o_orderkey LIMIT 10)")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Ten orders by key from a stored table: their buckets alone are opened."""
    kept = store.Store(spark, shared_folder(spark, "lookup"), key="o_orderkey", buckets=64)
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    kept.rebuild(orders)
    keys = [r[0] for r in orders.orderBy(F.desc(F.col("o_orderkey") % 101), "o_orderkey").select("o_orderkey").limit(10).collect()]
    return kept.lookup(keys)


@query("SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars, (SELECT count(*) FROM documents) AS listed, 2 AS generation FROM documents GROUP BY lang")
def published_pair(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and their manifest, published twice together and read back by the newest record."""
    pair = commits.Published(spark, shared_folder(spark, "pair"))
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    for rows in (docs.where("doc_id % 2 = 0"), docs):
        counts = rows.agg(F.count("*").alias("chunks"))
        number = pair.publish({"chunks": lambda p, rows=rows: store.write_lines(rows, p), "manifest": lambda p, counts=counts: store.write_lines(counts, p)})
    at = pair.paths()
    chunks = spark.read.schema("doc_id bigint, lang string, text string").json(at["chunks"])
    listed = spark.read.schema("chunks bigint").json(at["manifest"]).select(F.col("chunks").alias("listed"))
    out = chunks.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))
    return out.crossJoin(F.broadcast(listed)).withColumn("generation", F.lit(number))


@query("SELECT s_suppkey, s_name || CASE WHEN s_suppkey % 4 < 3 THEN '+' ELSE '' END AS s_name, 'backup-3,backup-2' AS kept FROM supplier")
def backups_kept(spark: SparkSession, d: str) -> DataFrame:
    """Four states of a table, each backed up; of the two that are kept the older is restored."""
    top = shared_folder(spark, "backups")
    kept = store.Store(spark, f"{top}/table", key="s_suppkey", buckets=4)
    kept.rebuild(table(spark, d, "supplier").select("s_suppkey", "s_name"))
    names: list[str] = []
    for n in range(4):
        names = kept.backup(f"{top}/copies", str(n), 2)
        kept.upsert(kept.read().where(F.col("s_suppkey") % 4 == n).withColumn("s_name", F.concat("s_name", F.lit("+"))), "s_suppkey")
    kept.restore(f"{top}/copies", names[0])
    return kept.read().withColumn("kept", F.lit(",".join(names)))
