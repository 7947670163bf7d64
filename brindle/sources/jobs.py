"""Job descriptions: a CSV listing joined with one Markdown file a row, with the rows that cannot be used kept apart under a code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.sources import files

# Column and section names of the corpus.
FILE, FINGERPRINT, TITLE, COMPANY, SALARY, EDUCATION, REGION, RELEVANCE = "文件", "JD指纹", "职位", "招聘主体", "薪资", "学历", "地区", "相关度"
COUNT, MAJOR, UPDATED, INDUSTRY, TYPE, SIZE, WORDS, COPIES, URL, SCORE = "招聘人数", "专业", "更新时间", "所属行业", "公司性质", "公司规模", "技术关键词", "同模板条数", "详情页", "相关度分值"
REQUIRED = [FINGERPRINT, TITLE, COMPANY, SALARY, EDUCATION, REGION, RELEVANCE]
BODY, BENEFITS = "职位原文", "福利标签"
FIELDS, COMPANY_FIELDS = [TITLE, SALARY, EDUCATION, COUNT, MAJOR, REGION, UPDATED, RELEVANCE], [COMPANY, INDUSTRY, TYPE, SIZE]


def section(markdown: Column, name: str) -> Column:
    """The text below the last heading ``## name``, up to the next such heading; empty if there is none."""
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace(markdown, "\r\n?", "\n")), r"\n##\s+")
    mine = F.filter(parts, lambda p: X.strip(F.split(p, "\n")[0]) == name)
    return F.when(F.size(mine) > 0, X.strip(F.regexp_replace(F.element_at(mine, -1), r"^[^\n]*(?:\n|$)", ""))).otherwise("")


def field_table(name: str, fields: list[str]) -> Column:
    rows = F.filter(F.array(*[F.when(X.table_cell(F.coalesce(F.col(f"`{f}`"), F.lit(""))) != "", F.concat(F.lit(f"| {f} | "), X.table_cell(F.col(f"`{f}`")), F.lit(" |"))) for f in fields]), lambda r: r.isNotNull())
    return F.concat_ws("\n", F.lit(f"## {name}\n\n| 字段 | 值 |\n|---|---|"), F.array_join(rows, "\n"))


def listing(spark: SparkSession, path: str, category: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).withColumn("category", F.lit(category))


def build(rows: DataFrame, markdown: DataFrame) -> DataFrame:
    """Rows of the listing (all columns as strings, and category) with their Markdown (path, content) as parents, and ``reject``: null, or why not.

    Of several rows with one id the first by file name is used, the others are duplicates. A row's id is its category and fingerprint."""
    names = set(rows.columns)
    rows = rows.select(*[X.strip(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in rows.columns], *[F.lit("").alias(c) for c in [FILE, *REQUIRED, COUNT, MAJOR, UPDATED, INDUSTRY, TYPE, SIZE, WORDS, COPIES, URL, SCORE] if c not in names])
    joined = rows.join(markdown.select(F.col("path").alias("source_path"), "content"), F.col(f"`{FILE}`") == F.element_at(F.split("source_path", "/"), -1), "left")
    text = files.utf8(F.col("content"))
    out = joined.withColumn("full_markdown", text).withColumn("s", X.salary(F.col(SALARY))).withColumn("body", section(F.coalesce("full_markdown", F.lit("")), BODY)).withColumn("benefits", section(F.coalesce("full_markdown", F.lit("")), BENEFITS))
    missing = None
    for c in REQUIRED:
        missing = (F.col(f"`{c}`") == "") if missing is None else missing | (F.col(f"`{c}`") == "")
    reject = F.when(F.col(FILE) == "", "missing_filename").when(F.col("content").isNull(), "markdown_not_found").when(F.col("full_markdown").isNull(), "not_utf8").when(missing, "missing_field").when(F.col("s").isNull(), "unsupported_salary").when(F.col("body") == "", "missing_section")
    out = out.withColumn("reject", reject).withColumn("jd_id", F.concat_ws(":", "category", FINGERPRINT))
    n = F.row_number().over(Window.partitionBy("jd_id", F.col("reject").isNull()).orderBy(FILE))
    out = out.withColumn("reject", F.when(F.col("reject").isNull() & (n > 1), "duplicate_jd_id").otherwise(F.col("reject")))
    row_json = F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in sorted(names - {"category"})]), {"ignoreNullFields": "false"})
    return out.select(
        "reject", F.col(FILE).alias("file"), "jd_id", F.col(FINGERPRINT).alias("fingerprint"), "category", "source_path", F.col(URL).alias("source_url"), F.col(TITLE).alias("title"), F.col(COMPANY).alias("company"), F.col(SALARY).alias("salary_raw"),
        F.col("s.min_k").alias("salary_min_k"), F.col("s.max_k").alias("salary_max_k"), F.col(EDUCATION).alias("education"), F.col(COUNT).alias("recruitment_count"), F.col(MAJOR).alias("major"), F.col(REGION).alias("region"), X.province(F.col(REGION)).alias("province"),
        F.col(UPDATED).alias("source_updated_at"), F.col(INDUSTRY).alias("industry"), F.col(TYPE).alias("company_type"), F.col(SIZE).alias("company_size"), F.col(RELEVANCE).alias("relevance"), X.first_int(F.col(SCORE)).alias("relevance_score"),
        X.job_function(F.col("category"), F.col(TITLE)).alias("function_category"), X.keywords(F.col(WORDS)).alias("keywords"), F.greatest(F.lit(1), X.first_int(F.col(COPIES))).alias("duplicate_count"), F.sha2(row_json, 256).alias("row_sha256"), F.sha2("full_markdown", 256).alias("parent_sha256"), "full_markdown",
        F.concat(F.lit("# "), F.col(TITLE), F.lit(f"\n\n## {BODY}\n\n"), X.strip(X.without_fences(F.col("body")))).alias("jd_text"),
        F.concat_ws("\n\n", F.concat(F.lit("# "), F.col(TITLE)), field_table("结构化字段", FIELDS), field_table("公司信息", COMPANY_FIELDS), F.when(F.col("benefits") != "", F.concat(F.lit(f"## {BENEFITS}\n\n"), F.col("benefits")))).alias("job_info"),
    )


def parents(built: DataFrame, strict: bool = False) -> DataFrame:
    """The usable rows; with ``strict`` any other row is an error."""
    if strict:
        bad = built.where("reject IS NOT NULL").select("file", "reject").head()
        if bad:
            raise ValueError(f"{bad['reject']}: {bad['file']}")
    return built.where("reject IS NULL").drop("reject")


def rejects(built: DataFrame) -> DataFrame:
    return built.where("reject IS NOT NULL").select("file", "source_path", "reject")


def children(parent: DataFrame) -> DataFrame:
    """Exactly two children of each parent, each with a hash over its content and metadata, so only what changes in them is embedded anew."""
    meta = ["category", "education", "parent_id", "province", "relevance", "salary_max_k", "salary_min_k", "source", "title"]
    rows = parent.withColumn("parent_id", F.col("jd_id")).withColumn("source", F.col("source_path"))
    kinds = F.array(*[F.struct(F.lit(k).alias("child_type"), F.col(k).alias("content")) for k in ("jd_text", "job_info")])
    rows = rows.withColumn("c", F.explode(kinds)).select(*meta, "c.*")
    digest = F.sha2(F.to_json(F.struct("content", F.struct(*[F.col(c) for c in sorted([*meta, "child_type"])]).alias("metadata"))), 256)
    return rows.withColumn("child_id", F.concat_ws(":", "parent_id", "child_type")).withColumn("index_sha256", digest)
