"""Token ids as length-delimited binary records with an offset index.

File format, little-endian throughout. A file is a run of frames; a frame holds one document:

    8 bytes  payload length n
    4 bytes  masked CRC-32 of those 8 bytes
    n bytes  payload: the token ids, each ``width`` bytes wide (2 if every id is below 65,536, else 4)
    4 bytes  masked CRC-32 of the payload

masked(c) = (c rotated right by 15 bits) + 0xa282ead8, modulo 2^32, so a checksum stored in checksummed data stays distinct.
The index is a table apart: file, frame offset, frame bytes, number of ids and the number of ids of all documents before
(``start``), so single records can be read in any order.

Order: files and frames ascend by key, nulls first, ties by the hash of the text. Null and empty texts hold the end id only.
Repeated rows are separate records. Extra input columns are not stored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.shared import Ranges, Scratch, own_columns, pieces, range_count

#: Text characters for which this module's split and the tokenizers library's agree beyond doubt; other texts go whole to the library.
_LATIN = re.compile(r"[\x00-\x1b\x20-\x84\x86-\x9f\xa1-ɏ‐-‧‰-⁞₠-₿]*")
#: Letters and numbers among those characters, and the tokenizer's split pattern spelled out with them.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
_SPLIT = re.compile(rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+").findall
#: Distinct pre-tokens whose ids a worker remembers at most, and how many of the first seen it keeps when that is reached.
REMEMBERED, KEPT = 600_000, 300_000


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(zlib.crc32(head))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def payload_of(block: bytes | memoryview) -> memoryview:
    """A frame's payload after both checks; ValueError if the frame is damaged."""
    view = memoryview(block)
    if len(view) < 16:
        raise ValueError("damaged record: short frame")
    (n,), (head,) = struct.unpack_from("<Q", view), struct.unpack_from("<I", view, 8)
    if head != masked(zlib.crc32(view[:8])) or len(view) != n + 16:
        raise ValueError("damaged record: length")
    if struct.unpack_from("<I", view, 12 + n)[0] != masked(zlib.crc32(view[12 : 12 + n])):
        raise ValueError("damaged record: payload")
    return view[12 : 12 + n]


class Tokens:
    """Ids by the tokenizers library. Each distinct pre-token of a Latin text is encoded by the library and remembered;
    the library splits by the same pattern and merges inside a pre-token only, so the joined ids are those of the whole text. A text that
    spells out a special token goes whole to the library, which gives it that token's id."""

    def __init__(self, file: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(file or public_tokenizers.path("byte_bpe_50k.json"))
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.known: dict[str, bytes] = {}
        (self.feed,) = self.library.encode("\n", add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def learn(self, words: list[str]) -> None:
        """Encode new pre-tokens, many in one call: a line feed between two of them is a token of its own, so it parts their ids."""
        if len(self.known) > REMEMBERED:
            self.known = dict(islice(self.known.items(), KEPT))
        odd = [w for w in words if w[1:].strip() != w[1:] or w.isspace()]
        words = [w for w in words if not (w[1:].strip() != w[1:] or w.isspace())] if odd else words
        for w in odd:
            self.known[w] = self.whole(w)
        for lo in range(0, len(words), 5000):
            part = words[lo : lo + 5000]
            ids = np.array(self.library.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, self.kind)
            at = np.flatnonzero(ids == self.feed).tolist()
            if len(at) != len(part) - 1:
                self.known.update((w, self.whole(w)) for w in part)
                continue
            blob, width = ids.tobytes(), self.width
            for w, a, z in zip(part, [0, *(i + 1 for i in at)], [*at, len(ids)], strict=True):
                self.known[w] = blob[a * width : z * width]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts."""
        split = [_SPLIT(t) if _LATIN.fullmatch(t) and not self.special.search(t) else None for t in texts]
        known = self.known
        if new := set().union(*filter(None, split)) - known.keys():
            self.learn(list(new))
        known, out = self.known, []
        for text, words in zip(texts, split, strict=True):
            if words is None:
                out.append(self.whole(text))
                continue
            try:
                out.append(b"".join(map(known.__getitem__, words)))
            except KeyError:  # forgotten meanwhile
                self.learn([w for w in dict.fromkeys(words) if w not in known])
                known = self.known
                out.append(b"".join([known[w] if w in known else self.whole(w) for w in words]))
        return out


@cache
def tokens(file: str | None = None) -> Tokens:
    return Tokens(file)


def _folder(uri: str):
    """The folder for tasks, which write and read without the JVM. Hadoop's names of the S3 connector mean the same store."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def write_records(docs: DataFrame, out_dir: str, key: str = "doc_id", text: str = "text", end_id: int = 0, file: str | None = None, parts: int | None = None) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write frames below ``out_dir`` (a URI that all executors reach).

    Returns the index as a lazy table; it must be evaluated once and stored (``store_records`` does): each evaluation of a task
    writes a file of a new name, and only files named in the stored index count, so a task that is lost or runs twice does no
    harm. Keys are cut at quantiles of one column-pruned pass, so only the texts themselves are shuffled, once.
    """
    rows = own_columns(docs, key, text)
    parts = parts or range_count(rows, 32)
    ranges = Ranges(rows, key, parts)
    dealt = rows.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.xxhash64(text).alias("__hash"))
    dealt = dealt.withColumn("__part", ranges.part(F.col("__key"), F.col("__hash")))
    dealt = ranges.deal(dealt, "__part").sortWithinPartitions("__part", "__key", "__hash")
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _folder(out_dir)
        enc = tokens(file)
        end = np.array([end_id], enc.kind).tobytes()
        name, stream, part, offset, before = "", None, None, 0, 0
        for batch in batches:
            for piece in pieces(batch, "__text", 2 << 20):
                out = []
                encoded = enc.encode_many([t or "" for t in piece.column("__text").to_pylist()])
                for p, k, got in zip(piece.column("__part").to_pylist(), piece.column("__key"), encoded, strict=True):
                    if p != part:
                        if stream:
                            stream.close()
                        part, offset, before = p, 0, 0
                        name = f"part-{p:05d}-{uuid.uuid4().hex}.rec"
                        stream = fs.open_output_stream(f"{top}/{name}")
                    payload = got + end
                    block = frame(payload)
                    stream.write(block)
                    n = len(payload) // enc.width
                    out.append((k.as_py(), p, name, offset, len(block), n, before))
                    offset, before = offset + len(block), before + n
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], piece.schema.field("__key").type), pa.array(cols[1], pa.int32()), pa.array(cols[2]), *[pa.array(c, pa.int64()) for c in cols[3:]]], [key, "part", "file", "offset", "bytes", "n_tokens", "before"])
        if stream:
            stream.close()

    return dealt.mapInArrow(run, f"`{key}` {kind}, part int, file string, offset bigint, bytes bigint, n_tokens bigint, before bigint")


def store_records(docs: DataFrame, scratch: Scratch, **options) -> tuple[DataFrame, str]:
    """Write records below the scratch folder; the stored index with ``start`` (ids of all documents before), and the folder.

    The totals of the files (one row a file) give each file's first start; that table is as small as the list of files."""
    spark = docs.sparkSession
    folder = scratch.dir()
    index = scratch.put(write_records(docs, folder, **options))
    totals = sorted((r["part"], r["n"]) for r in index.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    first, at = [], 0
    for part, n in totals:
        first.append((part, at))
        at += n
    base = spark.createDataFrame(first or [(0, 0)], "part int, base bigint")
    return index.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("before")).drop("base", "before"), folder


def read_records(index: DataFrame, folder: str, key: str = "doc_id", width: int = 2, ids: bool = False) -> DataFrame:
    """Read the frames that index rows name, in any order and any subset, checking both checksums.

    Returns key, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), and token_ids on request."""
    need = index.select(key, "file", "offset", "bytes", "start")
    kind = np.dtype(f"<u{width}")
    id_kind = dict(index.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _folder(folder)
        name, stream = None, None
        for batch in batches:
            for lo, hi in ((i, min(i + 2000, batch.num_rows)) for i in range(0, batch.num_rows, 2000)):
                part = batch.slice(lo, hi - lo)
                counts, crcs, blobs = [], [], []
                for f, offset, size in zip(*(part.column(c).to_pylist() for c in ("file", "offset", "bytes")), strict=True):
                    if f != name:
                        if stream:
                            stream.close()
                        name, stream = f, fs.open_input_file(f"{top}/{f}")
                    stream.seek(offset)
                    got = np.frombuffer(payload_of(stream.read(size)), kind).astype("<u4")
                    counts.append(len(got))
                    crcs.append(zlib.crc32(got))
                    blobs.append(got.tobytes() if ids else b"")
                cols = [part.column(key), part.column("start"), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), *[pa.array(blobs, pa.binary())] * ids]
                yield pa.RecordBatch.from_arrays(cols, [key, "start", "n_tokens", "ids_crc32", *["token_ids"] * ids])
        if stream:
            stream.close()

    return need.mapInArrow(run, f"`{key}` {id_kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", token_ids binary" * ids)


def read_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The round trip: write all texts, then read every record back."""
    index, folder = store_records(docs, Scratch(spark, "records"), **options)
    return read_records(index, folder, width=tokens(options.get("file")).width, key=options.get("key", "doc_id"))
