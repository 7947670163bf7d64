"""File scans: Markdown, HTML and PDF corpora, evaluation sets, seed files, listings.

Spark's file source lists every file on the driver and counts each as 4 MiB when it deals them to tasks, so that the results of its tasks alone outgrow the driver at some
millions of small files. Here tasks list the folders, a round for each level of large trees, into a table below ``spark.checkpoint.dir``; tasks dealt by files and bytes then
read them through ``pyarrow.fs``, and the driver gets counts only. The entries of one folder are held by one task. Folders on file systems that ``pyarrow.fs`` cannot
open from here are left to Spark's source.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.session import shared_folder

#: A task that has this many folders to go, or has seen this many files, hands the folders on to the next round.
WAITING, SEEN = 64, 10_000
#: Folders, files and bytes of files that one task gets about, and the most tasks there are.
FOLDERS, FILES, BYTES, TASKS = 256, 10_000, 64 << 20, 1 << 14
#: Bytes of contents after which a batch of them is handed to Spark.
BATCH = 8 << 20

ENTRY = "path string, size long, modified long, folder boolean"


def _relative(root: str) -> Column:
    """The path below the root, without scheme differences."""
    bare = root.split("://", 1)[-1].rstrip("/").split("/")
    tail = "/".join(bare[-2:])
    return F.regexp_replace("path", rf"^.*\Q{tail}\E/", "")


def _hidden(name: str) -> bool:
    """Names that Spark's sources pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")) or name.endswith("._COPYING_")


def _folder(uri: str):
    """The file system and the path of a URI, in the driver and in tasks."""
    from pyarrow import fs

    files, top = fs.FileSystem.from_uri(uri)
    return files, top.rstrip("/")


def _uri(spark: SparkSession, root: str) -> str | None:
    """The URI by which ``pyarrow.fs`` opens a folder; null where it cannot, or where there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    scheme, host, rest = re.fullmatch(r"([^:/]+):(?://([^/]*))?(.*)", full, re.S).groups()  # Hadoop's paths are not percent-encoded
    uri = f"{re.sub('^s3[an]$', 's3', scheme)}://{host or ''}{quote(rest)}"
    try:
        files, top = _folder(uri)
        return uri if files.get_file_info(top or "/").type.name == "Directory" else None
    except (OSError, pa.ArrowException):
        return None


def _dealt(rows: DataFrame, tasks: int) -> DataFrame:
    return rows.repartition(min(TASKS, max(tasks, rows.sparkSession.sparkContext.defaultParallelism)), "path")


def _entries(spark: SparkSession, uri: str, suffix: str) -> DataFrame:
    """path (relative), size and modified (milliseconds) of the files below a folder, as they were when this was called."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, top = _folder(uri)

        def below(at: str) -> list[tuple[str, int | None, int | None, bool]]:
            out = []
            for x in files.get_file_info(fs.FileSelector(f"{top}/{at}")):
                name = x.base_name
                if not _hidden(name) and (x.type == fs.FileType.Directory or x.is_file and name.endswith(suffix)):
                    out.append((f"{at}/{name}" if at else name, x.size, x.mtime_ns and x.mtime_ns // 1_000_000, not x.is_file))
            return out

        def batch(rows: list[tuple[str, int | None, int | None, bool]]) -> pa.RecordBatch:
            kinds = pa.string(), pa.int64(), pa.int64(), pa.bool_()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "size", "modified", "folder"])

        for b in batches:
            given, waiting, seen = deque(b.column("path").to_pylist()), deque(), 0
            while given or waiting and len(waiting) < WAITING and seen < SEEN:
                found = below((given or waiting).popleft())
                waiting.extend(r[0] for r in found if r[3])
                own = [r for r in found if not r[3]]
                seen += len(own)
                for i in range(0, len(own), SEEN):
                    yield batch(own[i : i + SEEN])
            if waiting:
                yield batch([(p, None, None, True) for p in waiting])

    store, rounds, folders = shared_folder(spark, "listing"), [], spark.range(1).select(F.lit("").alias("path"))
    while True:
        rounds.append(f"{store}/{len(rounds)}")
        folders.mapInArrow(walk, ENTRY).write.parquet(rounds[-1])
        folders = spark.read.schema(ENTRY).parquet(rounds[-1]).where("folder").select("path")
        n = folders.count()
        if not n:
            return spark.read.schema(ENTRY).parquet(*rounds).where("NOT folder").drop("folder")
        folders = _dealt(folders, -(-n // FOLDERS))


def _contents(uri: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _folder(uri)
        for b in batches:
            first, held, size = 0, [], 0
            for i, path in enumerate(b.column("path").to_pylist(), 1):
                with files.open_input_file(f"{top}/{path}") as f:
                    held.append(f.read())
                size += len(held[-1])
                if size >= BATCH or i == b.num_rows:
                    yield pa.RecordBatch.from_arrays([*b.slice(first, i - first).columns, pa.array(held, pa.binary())], [*b.schema.names, "content"])
                    first, held, size = i, [], 0

    return read


def scan(spark: SparkSession, root: str, suffix: str, only: Sequence[str] | None = None, content: bool = True) -> DataFrame:
    """path (relative), content, sha256 of the raw bytes, size of all files with a suffix below a folder; an empty scan is an error."""
    uri = _uri(spark, root)
    if uri:
        rows = _entries(spark, uri, suffix)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
        rows = files.withColumn("path", _relative(root)).withColumnRenamed("length", "size")
    if only is not None:
        rows = rows.where(F.col("path").isin(sorted(set(only))))
    n, size = rows.agg(F.count("*"), F.sum("size")).head()
    if not n:
        raise ValueError(f"no *{suffix} files below {root}")
    if uri and content:
        rows = _dealt(rows, max(-(-n // FILES), -(-size // BYTES))).mapInArrow(_contents(uri), "path string, size long, modified long, content binary")
    if uri:
        rows = rows.withColumn("modificationTime", F.timestamp_millis("modified"))
    return rows.select("path", *(["content", F.sha2("content", 256).alias("sha256")] if content else []), "size", "modificationTime")


def utf8(content: Column) -> Column:
    """The text of UTF-8 bytes without a byte order mark; null where they are none."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    return F.regexp_replace(text, "^\\ufeff", "")


def markdown(spark: SparkSession, root: str, only: Sequence[str] | None = None) -> DataFrame:
    return scan(spark, root, ".md", only).withColumn("text", utf8(F.col("content"))).drop("content")


def html(spark: SparkSession, root: str) -> DataFrame:
    """HTML pages; bytes that are no UTF-8, or the same bytes twice, are an error."""
    rows = scan(spark, root, ".html").withColumn("text", utf8(F.col("content"))).drop("content")
    bad = rows.where("text IS NULL").select("path").head()
    if bad:
        raise ValueError(f"not UTF-8: {bad[0]}")
    twice = rows.groupBy("sha256").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n > 1").head()
    if twice:
        raise ValueError(f"duplicate content: {twice['path']}")
    return rows


def listing(spark: SparkSession, root: str, suffixes: Sequence[str]) -> DataFrame:
    """path, size and quoted name of files, without reading them."""
    uri = _uri(spark, root)
    if uri:
        rows = _entries(spark, uri, "").select("path", "size")
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        rows = files.select(_relative(root).alias("path"), F.col("length").alias("size"))
    return rows.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin([s.lower() for s in suffixes])).withColumn("uri", F.replace(F.url_encode("path"), F.lit("%2F"), F.lit("/"))).orderBy("path")


def entries(paths: DataFrame, path: str = "path") -> DataFrame:
    """Of a repository's file list those that end in .md, in any case."""
    return paths.where(F.endswith(F.lower(F.col(path)), F.lit(".md")))


def accepted(files: DataFrame, most_bytes: int, name: str = "path", mime: str | None = None) -> DataFrame:
    """Uploaded PDFs with ``problem`` (null: accepted) and the hash of their bytes."""
    from brindle.operators.relational import file_problem

    kind = F.col(mime) if mime else F.lit("application/pdf")
    return files.withColumn("problem", file_problem(F.col(name), kind, F.col("content"), most_bytes)).withColumn("sha256", F.sha2("content", 256))


CASE = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("id", "query", "question", "notes", "group", "subject", "expected_tool", "expected_route")],
        *[T.StructField(n, T.ArrayType(T.StringType())) for n in ("expected_sources", "expected_title_keywords", "expected_tools")],
        T.StructField("requires_freshness", T.BooleanType()),
    ]
)


def _clean(items: str) -> Column:
    return F.coalesce(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of one JSONL file: blank lines skipped, id case_<line number> where none is given, group default, blanks dropped from lists; a case
    without a query is an error. An evaluation set is one small file, read whole so that its lines keep their numbers."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "^\\ufeff", ""), "\r?\n")).alias("n", "line"))
    rows = text.where(F.trim("line") != "").select((F.col("n") + 1).alias("line"), F.from_json("line", CASE).alias("c")).select("line", "c.*")
    query = F.coalesce("query", "question")
    rows = rows.withColumn("query", F.when(F.length(F.trim(query)) > 0, F.trim(query)).otherwise(F.raise_error(F.concat(F.lit("a case has no query: line "), F.col("line").cast("string")))))
    rows = rows.withColumn("id", F.coalesce("id", F.format_string("case_%03d", "line"))).withColumn("group", F.coalesce("group", F.lit("default")))
    return rows.select("line", "id", "query", "group", "subject", "expected_tool", "expected_route", "requires_freshness", "notes", *[_clean(c).alias(c) for c in ("expected_sources", "expected_title_keywords", "expected_tools")])


def select_cases(cases: DataFrame, ids: Sequence[str] | None = None, positive_only: bool = False, limit: int | None = None) -> DataFrame:
    """Named cases in the order given (an unknown id is an error), or all in file order."""
    rows = cases.where(F.size("expected_sources") > 0) if positive_only else cases
    if ids is None:
        rows = rows.orderBy("line")
    else:
        wanted = cases.sparkSession.createDataFrame(list(enumerate(ids)), "place int, id string")
        unknown = wanted.join(cases, "id", "left_anti").head()
        if unknown:
            raise ValueError(f"unknown case: {unknown['id']}")
        rows = rows.join(F.broadcast(wanted), "id").orderBy("place").drop("place")
    return rows if limit is None else rows.limit(limit)


def case_modes(cases: DataFrame, modes: Sequence[str]) -> DataFrame:
    """Every case in every mode."""
    return cases.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))


def seed_items(spark: SparkSession, path: str) -> DataFrame:
    """The items of a seed file {version, items: [...]}."""
    return spark.read.option("multiLine", True).json(path).select("version", F.explode("items").alias("item")).select("version", "item.*")


def collections(entries_: DataFrame, prefix: str, column: str = "collection") -> DataFrame:
    """Names of the shards that exist."""
    return entries_.select(column).distinct().where(F.startswith(F.col(column), F.lit(prefix))).orderBy(column)


def web_results(raw: DataFrame, order: str = "place", most_chars: int = 500) -> DataFrame:
    """Results with a title and a safe URL, the first of each URL, snippets cut."""
    from brindle.functions.text import safe_url

    rows = raw.select(order, F.trim("title").alias("title"), safe_url(F.trim("url")).alias("url"), F.substring(F.coalesce("content", F.lit("")), 1, most_chars).alias("snippet"), "published_at").where("title <> '' AND url IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("url").orderBy(order))
    return rows.withColumn("__n", first).where("__n = 1").drop("__n").withColumn("domain", F.regexp_extract("url", r"^https://(\[[^\]]*\]|[^/:?]+)", 1))


def pdf_pages(files: DataFrame, most_pages: int = 1000, most_chars: int = 5_000_000) -> DataFrame:
    """document_id, page_number, width, height, blocks and error of PDF bytes (columns path, content). Needs PyMuPDF on the executors; where it
    is missing every file has the error ``parser_missing``. Text blocks are sorted, image blocks dropped."""
    import pandas as pd

    from brindle.operators.chunk_pages import BLOCK

    schema = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("page_number", T.IntegerType()), T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType()), T.StructField("blocks", T.ArrayType(BLOCK)), T.StructField("error", T.StringType())])
    names = [f.name for f in schema]

    def parse(path: str, content: bytes):
        try:
            import fitz
        except ImportError:
            return [(path, None, None, None, None, "parser_missing")]
        try:
            with fitz.open(stream=content, filetype="pdf") as pdf:
                if pdf.page_count > most_pages:
                    return [(path, None, None, None, None, "too_many_pages")]
                out, chars = [], 0
                for n, page in enumerate(pdf, 1):
                    blocks = [b for b in page.get_text("blocks", sort=True) if b[6] == 0 and b[4].strip()]
                    chars += sum(len("".join(b[4].split())) for b in blocks)
                    found = [{"block_index": i, "block_type": "text", "bbox": [float(x) for x in b[:4]], "text": b[4].strip()} for i, b in enumerate(blocks)]
                    out.append((path, n, float(page.rect.width), float(page.rect.height), found, None))
                return out if chars <= most_chars else [(path, None, None, None, None, "too_long")]
        except Exception as e:  # one damaged file must not end the job; its error is data
            return [(path, None, None, None, None, type(e).__name__)]

    def run(batches):
        for batch in batches:
            rows = [r for p, c in zip(batch["path"], batch["content"], strict=True) for r in parse(p, bytes(c))]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)
