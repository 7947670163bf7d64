"""Parsed page documents: validation, and chunks that never cross a page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.text import visible_chars
from brindle.operators.chunk_markdown import windows

SIZE, OVERLAP = 2000, 300
BLOCK = T.StructType([T.StructField("block_index", T.IntegerType()), T.StructField("block_type", T.StringType()), T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("text", T.StringType())])
PAGE = T.StructType([T.StructField("page_number", T.IntegerType()), T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType()), T.StructField("blocks", T.ArrayType(BLOCK))])
DOCUMENT = T.StructType([T.StructField("schema_version", T.IntegerType()), T.StructField("document_id", T.StringType()), T.StructField("original_filename", T.StringType()), T.StructField("page_count", T.IntegerType()), T.StructField("extracted_char_count", T.IntegerType()), T.StructField("pages", T.ArrayType(PAGE))])


def problems(documents: DataFrame, most_pages: int = 1000, most_chars: int = 5_000_000) -> DataFrame:
    """document_id and the first rule it breaks."""
    pages = F.col("pages")
    numbered = F.forall(F.transform(pages, lambda p, i: p["page_number"] == i + 1), lambda ok: ok)
    indexed = F.forall(pages, lambda p: F.forall(F.transform(p["blocks"], lambda b, i: b["block_index"] == i), lambda ok: ok))
    boxes = F.forall(pages, lambda p: F.forall(p["blocks"], lambda b: F.size(b["bbox"]) == 4))
    chars = F.aggregate(F.flatten(F.transform(pages, lambda p: p["blocks"])), F.lit(0), lambda s, b: s + visible_chars(b["text"]))
    rule = F.when(F.col("schema_version") != 1, "schema_version").when((F.size(pages) == 0) | (F.size(pages) != F.col("page_count")), "page_count")
    rule = rule.when(F.size(pages) > most_pages, "too_many_pages").when(~numbered, "page_number").when(~indexed, "block_index").when(~boxes, "bbox").when(chars != F.col("extracted_char_count"), "char_count").when(chars > most_chars, "too_long")
    return documents.select("document_id", rule.alias("problem")).where("problem IS NOT NULL")


def identity_problems(documents: DataFrame, records: DataFrame) -> DataFrame:
    """Documents whose id, file name or page count differ from their record."""
    r = records.select(F.col("id").alias("document_id"), F.col("original_filename").alias("f"), F.col("page_count").alias("n"))
    joined = documents.join(r, "document_id", "left")
    return joined.where(F.col("f").isNull() | (F.col("f") != F.col("original_filename")) | (F.col("n") != F.col("page_count"))).select("document_id")


def page_chunks(texts: list[str], size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Blocks of one page packed with an empty line between; a longer block in windows."""
    out: list[str] = []
    open_ = False
    for text in (t.strip() for t in texts):
        if not text:
            continue
        if len(text) > size:
            out += windows(text, size, overlap)
            open_ = False
        elif open_ and len(out[-1]) + 2 + len(text) <= size:
            out[-1] += "\n\n" + text
        else:
            out.append(text)
            open_ = True
    return out


def _parts(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of pages whose texts have about ``most`` bytes, or one longer page alone: what becomes Python objects at a time."""
    texts = batch.column(2)
    size = pc.fill_null(pc.binary_length(texts.flatten()), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
    ends = np.cumsum(pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    upto = np.concatenate([[0], np.cumsum(size)])[ends]
    lo, done = 0, 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, done + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo, done = hi, int(upto[hi - 1])


def chunk_table(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """document_id, chunk_index, page_start, page_end, text of all documents with ``pages`` as in DOCUMENT. A page is the unit of work; indexes are numbered per document."""
    pages = documents.select("document_id", F.explode("pages").alias("p")).select("document_id", F.col("p.page_number").alias("page"), F.transform("p.blocks", lambda b: b["text"]).alias("texts"))
    schema = "document_id string, page int, k int, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                rows = [(d, p, k, t) for d, p, texts in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True) for k, t in enumerate(page_chunks([x or "" for x in texts or []], size, overlap))]
                if rows:
                    a, b, c, e = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int32()), pa.array(c, pa.int32()), pa.array(e, pa.string())], ["document_id", "page", "k", "text"])

    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("document_id").orderBy("page", "k")) - 1
    return pages.mapInArrow(run, schema).select("document_id", n.alias("chunk_index"), F.col("page").alias("page_start"), F.col("page").alias("page_end"), "text")
