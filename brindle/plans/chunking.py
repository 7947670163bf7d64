"""Queries: chunking of texts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.operators import chunk_html, chunk_markdown, chunk_pages
from brindle.plans.registry import query, table


@query()
def chunk_markdown_docs(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth line becomes a heading, its first 40 characters, and what it has beyond them the next line; a line with nothing to head stays a paragraph."""
    docs = table(spark, d, "documents")
    split = F.split("text", "\n")
    rest = lambda x: F.substring(x, F.lit(41), F.length(x))
    heads = lambda x, i: (i % 5 == 0) & F.rlike(F.concat(rest(x), F.array_join(F.slice(split, i + 2, F.lit(4)), "")), F.lit(r"\S"))
    head = lambda x: F.concat(F.lit("## "), F.substring(x, 1, 40), F.when(F.length(x) > 40, F.concat(F.lit("\n"), rest(x))).otherwise(F.lit("")))
    lines = F.transform(split, lambda x, i: F.when(heads(x, i), head(x)).otherwise(x))
    return chunk_markdown.chunk_table(docs.select("doc_id", F.array_join(lines, "\n").alias("text")), "doc_id", "text")


@query("""SELECT doc_id, i AS chunk_index, substr(text, (i * 450 + 1)::BIGINT, 500) AS content FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil((length(text) - 50) / 450.0))::BIGINT)) AS i FROM documents)""")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    """Fixed windows of 500 characters that overlap by 50."""
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - 50) / 450)).cast("long")
    rows = table(spark, d, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk_index"))
    return rows.select("doc_id", "chunk_index", F.expr("substring(text, CAST(chunk_index * 450 + 1 AS INT), 500)").alias("content"))


@query()
def chunk_page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a document as the blocks of one page."""
    block = lambda x, i: F.struct(i.alias("block_index"), F.lit("text").alias("block_type"), F.array(*[F.lit(0.0)] * 4).alias("bbox"), x.alias("text"))
    page = F.struct(F.lit(1).alias("page_number"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"), F.transform(F.split("text", "\n"), block).alias("blocks"))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.array(page).alias("pages"))
    return chunk_pages.chunk_table(docs)


@query()
def html_text_extract(spark: SparkSession, d: str) -> DataFrame:
    return chunk_html.text_table(table(spark, d, "pages"), "url", "html")


@query()
def html_units(spark: SparkSession, d: str) -> DataFrame:
    """Pages with each article as a slide."""
    pages = table(spark, d, "pages").select("url", F.regexp_replace(F.regexp_replace("html", "<article>", '<section class="content-slide">'), "</article>", "</section>").alias("html"))
    return chunk_html.unit_table(pages, "url", "html")


@query()
def chunk_tokens(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("url", F.regexp_replace(F.regexp_replace("html", "<article>", '<section class="content-slide">'), "</article>", "</section>").alias("html"))
    return chunk_html.record_table(pages, "url", "html")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'qa' WHEN doc_id % 4 = 1 THEN 'trend' WHEN doc_id % 4 = 2 THEN 'topic' ELSE 'article' END AS kind FROM documents")
def unit_kinds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    title = F.when(k == 0, "Q 3 what").when(k == 1, "from 2023 to 2025").when(k == 2, "plain").otherwise("")
    return table(spark, d, "documents").select("doc_id", X.unit_kind(title, F.lit("since 2023")).alias("kind"))
