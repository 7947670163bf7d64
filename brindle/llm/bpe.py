"""Byte-level BPE by the tiktoken library with a local rank file.

``encode_documents`` adds the token ids' digest columns (and the ids on request); ``decode`` gives the raw bytes of ids.
Null and empty texts have no tokens. Texts of any length are encoded whole: a long text is first cut where no match of the split
pattern can reach across (after an ASCII letter or digit, before a blank or line feed), so the pieces' ids joined are the ids of
the whole. A long text without such a place is encoded in one piece. A run of over 100,000 blanks, whose split by the pattern's
look-ahead would exhaust the library's stack, is split by rule: all of it, or all but the last blank if more text follows, is one match. Repeated rows give repeated results; extra input columns
pass through, those named like an output are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from brindle.llm.shared import pieces, without

#: Texts longer than this many characters are cut at safe boundaries.
LONG = 200_000
_SAFE = re.compile(r"[0-9A-Za-z](?=[ \n])")
#: Blanks as the split pattern knows them, in runs too long for its look-ahead.
RUN = 100_000
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN)


@cache
def encoding(rank_file: str | None = None, pattern: str | None = None):
    """The encoding of a tiktoken rank file, without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
    return tiktoken.Encoding("local", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, long: int = LONG) -> Iterator[str]:
    """The text in pieces of about ``long`` characters, cut only where the split pattern always ends a match."""
    at = 0
    while len(text) - at > long and (m := _SAFE.search(text, at + long - 1)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


def encode(text: str | None, rank_file: str | None = None, long: int = LONG) -> np.ndarray:
    """Token ids (unsigned 32-bit) of a whole text."""
    if not text:
        return np.zeros(0, np.uint32)
    enc, found, at = encoding(rank_file), [], 0
    for run in _RUN.finditer(text) if len(text) >= RUN else ():
        end = run.end() - (run.end() < len(text))
        found += [enc.encode_to_numpy(piece, disallowed_special=()) for piece in safe_pieces(text[at : run.start()], long)]
        found.append(np.array(enc._encode_single_piece(text[run.start() : end]), np.uint32))
        at = end
    found += [enc.encode_to_numpy(piece, disallowed_special=()) for piece in safe_pieces(text[at:] if at else text, long)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def decode(ids: np.ndarray, rank_file: str | None = None, block: int = 1 << 18) -> Iterator[bytes]:
    """The raw bytes of ids, in blocks; a block may end inside a character."""
    enc = encoding(rank_file)
    for at in range(0, len(ids), block):
        yield enc.decode_bytes(ids[at : at + block].tolist())


def encode_documents(docs: DataFrame, text: str = "text", rank_file: str | None = None, ids: bool = False) -> DataFrame:
    """All columns of ``docs``, and n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256; with ``ids`` also
    token_ids (binary, the same layout). One pass, no shuffle."""
    out = ["n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * ids]
    kept, names = without(docs, *out)
    column, kinds = f"c{names.index(text)}", {"n_tokens": T.LongType(), "token_ids": T.BinaryType()}
    schema = T.StructType([*kept.schema, *[T.StructField(c, kinds.get(c, T.StringType())) for c in out]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, column, 8 << 20):
                counts, digests, plain, blobs = [], [], [], []
                for t in part.column(column):
                    found = encode(t.as_py(), rank_file)
                    blob, back = found.astype("<u4").tobytes(), hashlib.sha256()
                    for block in decode(found, rank_file):
                        back.update(block)
                    counts.append(len(found))
                    digests.append(hashlib.sha256(blob).hexdigest())
                    plain.append(back.hexdigest())
                    blobs.append(blob if ids else b"")
                more = [pa.array(counts, pa.int64()), pa.array(digests), pa.array(plain), *[pa.array(blobs, pa.binary())] * ids]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], schema.names)

    return kept.mapInArrow(run, schema).toDF(*names, *out)
