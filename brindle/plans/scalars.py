"""Queries: scalar functions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.plans.registry import query, table

RULES = [("steel", ["steel"]), ("copper", ["copper", "nickel"]), ("brass", ["brass"]), ("promo", ["promo"])]


@query("""SELECT p_partkey, least(a, b) AS min_k, greatest(a, b) AS max_k FROM (
    SELECT p_partkey, p_size::DOUBLE AS a, (p_size * 7 % 50)::DOUBLE AS b FROM part WHERE p_partkey % 5 <> 0)""")
def parse_salary(spark: SparkSession, d: str) -> DataFrame:
    """Salary texts made of two numbers; every fifth one is no salary and is rejected."""
    a, b = F.col("p_size").cast("string"), (F.col("p_size") * 7 % 50).cast("string")
    said = F.when(F.col("p_partkey") % 5 == 0, F.concat(a, F.lit(" per day"))).otherwise(F.concat(a, F.lit("k - "), b, F.lit("K")))
    rows = table(spark, d, "part").select("p_partkey", X.salary(said).alias("s"))
    return rows.where("s IS NOT NULL").select("p_partkey", "s.min_k", "s.max_k")


@query("""SELECT CASE WHEN contains(lower(p_type), 'steel') THEN 'steel' WHEN contains(lower(p_type), 'copper') OR contains(lower(p_type), 'nickel') THEN 'copper'
    WHEN contains(lower(p_type), 'brass') THEN 'brass' WHEN contains(lower(p_type), 'promo') THEN 'promo' ELSE '其他' END AS kind, count(*) AS n FROM part GROUP BY 1""")
def classify_first_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(X.first_match(F.col("p_type"), RULES).alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, array_to_string(list_sort(list_distinct([year(o_orderdate), 1900 + (o_custkey % 100)])), ',') AS years FROM orders""")
def year_tags(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("since "), F.year("o_orderdate").cast("string"), F.lit(", not 12345 but "), (1900 + F.col("o_custkey") % 100).cast("string"), F.lit(" and "), F.year("o_orderdate").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(X.year_tags(said).cast("array<string>"), ",").alias("years"))


_PLAIN_SECRETS = "|".join(f"(?:{p})" for p in X.SECRETS).replace("(?i)", "").replace("'", "''")


@query(f"SELECT doc_id, regexp_matches(text, '(?i)' || '{_PLAIN_SECRETS}') AS sensitive FROM documents")
def sensitive_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.is_sensitive(F.col("text")).alias("sensitive"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '^[hH][tT][tT][pP][sS]://') THEN 'https://' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+(.*)$', 1), '#.*$', '') END AS safe FROM pages""")
def url_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.safe_url(F.col("url")).alias("safe"))


@query(r"""SELECT doc_id, CASE WHEN length(t) > 30 THEN substr(t, 1, 30) || '...' ELSE t END AS title, CASE WHEN length(s) > 140 THEN substr(s, 1, 140) || '...' ELSE s END AS excerpt,
    length(regexp_replace(text, '\s', '', 'g')) AS visible FROM (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents)""")
def titles_and_excerpts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.title(t).alias("title"), X.excerpt(t).alias("excerpt"), X.visible_chars(t).cast("long").alias("visible"))


@query(r"""SELECT doc_id, substr(sha256(text), 1, 12) AS query_sha256, length(text) AS query_length, sha256('{"doc_id":' || doc_id || ',"lang":' || CASE WHEN lang IS NULL THEN 'null' ELSE '"' || lang || '"' END || '}') AS canonical FROM documents""")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    h = X.query_hash(F.col("text"))
    return table(spark, d, "documents").select("doc_id", h["query_sha256"].alias("query_sha256"), h["query_length"].cast("long").alias("query_length"), X.canonical_sha(lang=F.col("lang"), doc_id=F.col("doc_id")).alias("canonical"))


@query("""SELECT r_regionkey, CASE WHEN r_regionkey = 0 THEN '未知' WHEN r_regionkey = 1 THEN '全国' WHEN r_regionkey = 2 THEN '北京' WHEN r_regionkey = 3 THEN '广东省' ELSE '内蒙古自治区' END AS province FROM region""")
def province_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("r_regionkey")
    place = F.when(k == 0, " ").when(k == 1, "全国/远程").when(k == 2, "北京市海淀区").when(k == 3, "广东省深圳市").otherwise("内蒙古呼和浩特市、北京市")
    return table(spark, d, "region").select("r_regionkey", X.province(place).alias("province"))


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN try_cast(json_extract_string(props, '$.k') AS INTEGER) > 5 THEN 5 WHEN try_cast(json_extract_string(props, '$.k') AS INTEGER) < 1 THEN 1 ELSE coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), 3) END AS "limit" FROM events""")
def clamped_limit(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", k.try_cast("int").alias("k"), X.clamp_int(k, 1, 5, 3).alias("limit"))


@query("""SELECT l_orderkey, l_linenumber, round(sum(printf('%.4f', l_extendedprice * l_discount / 7)::DOUBLE), 6) AS four, round(sum(printf('%.2f', l_extendedprice * l_discount / 8)::DOUBLE), 6) AS two
    FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def rounded_prices(spark: SparkSession, d: str) -> DataFrame:
    """Shares of prices rounded as Python does, to the exact binary value's nearest decimal."""
    share = lambda n: F.col("l_extendedprice").cast("double") * F.col("l_discount").cast("double") / n
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.rounded(share(7), 4).alias("four"), X.rounded(share(8), 2).alias("two"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.round(F.sum("four"), 6).alias("four"), F.round(F.sum("two"), 6).alias("two"))
