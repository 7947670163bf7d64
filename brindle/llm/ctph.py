"""Context-triggered piecewise hashing of documents.

A rolling hash over seven bytes ends a chunk wherever it is -1 modulo the block size; each chunk gives one of 64 characters, so an edit changes
only the characters near it. The block size is the least 3 * 2**k at which 64 chunks would span the text, halved while fewer than
32 chunks come out. A fingerprint ``size:chunks:chunks`` has the chunks at that size and at twice that size; two fingerprints are compared
where their sizes are compatible (equal, or one twice the other), by edit distance with insertions and deletions.

Null counts as the empty text, whose fingerprint is ``3::``. Equal texts have equal fingerprints, and likeness 1. Very long texts are
read in blocks of a mebibyte. Ties of the key are ordered by the hash of the text; rows equal in both are interchangeable. Nulls come first. A
table of one row is its own next document; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.shared import Ranges, own_columns, pieces, range_count

WINDOW, LEAST, LENGTH = 7, 3, 64
_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_CODE = np.zeros(128, np.int64)
_CODE[[ord(c) for c in _CHARS]] = np.arange(64)
_REPEATS = re.compile(r"(.)\1{3,}")


def _rolling(block: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: the window's sum, its weighted sum and its shifted exclusive or, added up."""
    n = len(block)
    p = np.zeros(n + WINDOW - 1, np.uint32)
    p[WINDOW - 1 - len(before) : WINDOW - 1] = before
    p[WINDOW - 1 :] = block
    plain, weighted, mixed = p[WINDOW - 1 :].copy(), p[WINDOW - 1 :] * np.uint32(WINDOW), p[WINDOW - 1 :].copy()
    for j in range(1, WINDOW):
        x = p[WINDOW - 1 - j : WINDOW - 1 - j + n]
        plain += x
        weighted += x * np.uint32(WINDOW - j)
        mixed ^= x << np.uint32(5 * j)
    plain += weighted
    plain += mixed
    return plain


def _triggers(data: np.ndarray, size: int, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Where the hash plus one is a multiple of ``size``, and its value there."""
    at, values = [], []
    for lo in range(0, len(data), block):
        h = _rolling(data[lo : lo + block], data[max(0, lo - WINDOW + 1) : lo]) + np.uint32(1)
        hit = np.flatnonzero(h % np.uint32(size) == 0)
        at.append(hit + lo)
        values.append(h[hit])
    return (np.concatenate(at), np.concatenate(values)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint32))


def _chunks(raw: bytes, ends: np.ndarray, most: int) -> str:
    view, at, out = memoryview(raw), 0, []
    for end in ends[: most - 1].tolist():
        out.append(_CHARS[zlib.crc32(view[at : end + 1]) & 63])
        at = end + 1
    if at < len(raw):
        out.append(_CHARS[zlib.crc32(view[at:]) & 63])
    return "".join(out)


def fingerprint(raw: bytes) -> str:
    size = LEAST
    while size * LENGTH < len(raw):
        size *= 2
    data = np.frombuffer(raw, np.uint8)
    low = max(LEAST, size // 4)
    at, values = _triggers(data, low)
    while size > LEAST:
        if size < low:
            low = size
            at, values = _triggers(data, low)
        if np.count_nonzero(values % np.uint32(size) == 0) >= LENGTH // 2 - 1:
            break
        size //= 2
    if size < low:
        at, values = _triggers(data, size)
    return f"{size}:{_chunks(raw, at[values % np.uint32(size) == 0], LENGTH)}:{_chunks(raw, at[values % np.uint32(2 * size) == 0], LENGTH // 2)}"


def _common(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair of strings of 64 characters at most: bit by bit, all pairs at once."""
    n = len(a)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    wide = max(1, max(map(len, a)))
    table = np.zeros((n, 64), np.uint64)
    left = np.frombuffer("".join(x.ljust(wide, "\0") for x in a).encode(), np.uint8).reshape(n, wide)
    high = max(1, max(map(len, b)))
    right = np.frombuffer("".join(x.ljust(high, "\0") for x in b).encode(), np.uint8).reshape(n, high)
    rows = np.arange(n)
    for i in range(wide):
        on = left[:, i] > 0
        table[rows[on], _CODE[left[on, i]]] |= np.uint64(1 << i)
    v = np.full(n, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(high):
            m = np.where(right[:, j] > 0, table[rows, _CODE[right[:, j]]], np.uint64(0))
            u = v & m
            v = (v + u) | (v - u)
    own = np.array([(1 << len(x)) - 1 for x in a], np.uint64)
    return np.bitwise_count(~v & own).astype(np.int64)


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints: one minus the edit distance over the summed lengths, at the best compatible block size; 0 without a
    common run of four characters (half the length of shorter ones)."""
    out = np.zeros(len(pairs))
    who, left, right = [], [], []
    for i, (x, y) in enumerate(pairs):
        if x == y:
            out[i] = 1
            continue
        (s, a1, a2), (t, b1, b2) = x.split(":"), y.split(":")
        s, t = int(s), int(t)
        for a, b in ((a1, b1), (a2, b2)) if s == t else ((a2, b1),) if 2 * s == t else ((a1, b2),) if s == 2 * t else ():
            a, b = _REPEATS.sub(r"\1\1\1", a), _REPEATS.sub(r"\1\1\1", b)
            run = min(4, max(1, min(len(a), len(b)) // 2), len(a), len(b))
            if run and not {a[k : k + run] for k in range(len(a) - run + 1)}.isdisjoint(b[k : k + run] for k in range(len(b) - run + 1)):
                who.append(i)
                left.append(a)
                right.append(b)
    if who:
        score = 2 * _common(left, right) / np.array([len(a) + len(b) for a, b in zip(left, right, strict=True)])
        np.maximum.at(out, np.array(who), score)
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint of each row: one pass, no shuffle."""
    rows = own_columns(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text, 4 << 20):
                found = [fingerprint((t or "").encode()) for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(found, pa.string())], [key, "fingerprint"])

    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by as many first ones of the following text, or all that has."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Each document beside its edited text and beside the next document by key.

    Texts are shuffled once, into ranges of the key; the first row of each range is sent to the range before as well (the very first
    to the last), so each task sees every next document and no task sees more than its range."""
    rows = own_columns(docs, key, text)
    spark, kind = docs.sparkSession, dict(rows.dtypes)[key]
    parts = parts or range_count(rows, 48)
    ranges = Ranges(rows, key, parts)
    tagged = rows.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    tagged = tagged.withColumn("part", ranges.part(F.col("k"), F.col("h")))
    first = tagged.groupBy("part").agg(F.min(F.struct("k", "h")).alias("f")).orderBy("part").collect()  # a row for each range
    ahead = [(first[i - 1]["part"], r["part"], r["f"]["k"], r["f"]["h"]) for i, r in enumerate(first)]
    marks = F.broadcast(spark.createDataFrame(ahead, f"to int, part int, k {kind}, h bigint"))
    extra = tagged.join(marks, (tagged.part == marks.part) & tagged.k.eqNullSafe(marks.k) & (tagged.h == marks.h)).select(marks["to"].alias("part"), F.lit(1).alias("role"), tagged.k, tagged.t, tagged.h)
    dealt = tagged.select("part", F.lit(0).alias("role"), "k", "t", "h").unionByName(extra)
    dealt = ranges.deal(dealt, "part").sortWithinPartitions("part", "role", "k", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row of a range so far: part, key, text, its fingerprint
        done = None  # the range whose next row has been seen
        for batch in batches:
            for piece in pieces(batch, "t", 2 << 20):
                out = []
                for p, role, k, t in zip(*(piece.column(c).to_pylist() for c in ("part", "role", "k", "t")), strict=True):
                    if role and done == p:
                        continue
                    t = t or ""
                    fp = fingerprint(t.encode())
                    if held is not None:
                        e = edited(held[2], t).encode()
                        out.append((held[1], len(held[2]), hashlib.sha256(e).hexdigest(), held[3], fingerprint(e), fp))
                    held, done = (None, p) if role else ((p, k, t, fp), done)
                if out:
                    keys, chars, shas, own, changed, nxt = zip(*out, strict=True)
                    near = likeness([*zip(own, changed, strict=True), *zip(own, nxt, strict=True)])
                    cols = [pa.array(keys, piece.schema.field("k").type), pa.array(chars, pa.int64()), pa.array(shas), pa.array(own), pa.array(changed), pa.array(near[: len(out)]), pa.array(near[len(out) :])]
                    yield pa.RecordBatch.from_arrays(cols, [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(run, f"`{key}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
