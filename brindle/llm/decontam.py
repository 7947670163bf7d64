"""Benchmark decontamination by suffix arrays over the training words.

The training words are cut into shards (runs of documents, or overlapping runs of one very long document). Each task builds the
suffix array of a shard in memory, ordered by ranks that triple their depth, and every benchmark suffix is binary-searched in it, word
by word: the range of equal suffixes shrinks until it is empty, which gives the longest verbatim match, its places, and, at the
window's depth, every occurrence of the window. Nothing is shuffled. The tasks search all blocks of the benchmark in each array, one after another; a
benchmark of more than PASS_BYTES takes several passes, between which the rows are written, so memory does not grow with it.

Words: ASCII capitals are lower-cased; a word is a run of ASCII letters, digits and non-ASCII characters. Words are compared by
64-bit hashes (a false match of a ten-word window would need ten collisions in a row). A window is ``window`` consecutive words
of an item; an item with fewer, but not none, is one window. Texts of any length are hashed in blocks.

Null and empty texts have no words, are never hit, and their items have no window. Repeated rows give repeated results. Repeated item_ids count
once; a null item_id counts as ``null``. Without benchmark rows nothing is hit. Extra columns are ignored by ``contamination`` and pass
through ``clean``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import words as W
from brindle.llm.shared import Scratch, byte_sizes, flat, own_columns, pieces, positional, spans

WINDOW = 10
#: Bytes of benchmark text in a block and in all blocks of a pass (a longer item is a block of its own), and of training text in a shard.
BLOCK_BYTES, PASS_BYTES, SHARD_BYTES = 8 << 20, 32 << 20, 2 << 20
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_NO_ITEMS = hashlib.sha256(b"").hexdigest()


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and each text's number of words."""
    data, offsets = flat(texts)
    found, counts = [], []
    for lo, hi in spans(np.diff(offsets), W.PART):
        at, end = int(offsets[lo]), int(offsets[hi])
        if end - at > W.PART:  # one long text
            hashed = [h for _, h in W.long_text(data[at:end], _WORD, W.PART)]
            found += hashed
            counts.append(np.array([sum(map(len, hashed))]))
            continue
        edges, low = offsets[lo : hi + 1] - at, W.LOWER[data[at:end]]
        starts, ends = W.runs(_WORD[low], edges)
        found.append(W.hashes(low, starts, ends))
        counts.append(np.bincount(W.owners(edges, starts), minlength=hi - lo))
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), (np.concatenate(counts) if counts else np.zeros(0, np.int64))


class Block:
    """Benchmark items of one pass: their words, and each suffix's item, offset, remaining words and window length."""

    def __init__(self, ids: list, texts: pa.Array, window: int):
        hashed, counts = word_hashes(texts)
        self.names = ["null" if i is None else str(i) for i in ids]
        self.longest = int(counts.max(initial=0))
        self.item = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        begin = np.cumsum(counts) - counts
        self.offset = (np.arange(len(hashed)) - begin[self.item]).astype(np.int32)
        self.left = (counts[self.item] - self.offset).astype(np.int32)
        self.need = np.where(counts[self.item] >= window, np.where(self.left >= window, window, 0), np.where(self.offset == 0, self.left, 0)).astype(np.int32)
        self.words = np.concatenate([hashed, np.zeros(1, np.uint64)])
        self.window = window


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions ordered by their next words, ``depth`` at least; the ranks at the depth reached; that depth.

    ids: integers from 0, 0 between documents. As many ranks of neighbours as 64 bits hold (two of 32 bits at least) are one key, so the depth
    doubles or better each time."""
    n, reached, rank = len(ids), 1, ids.astype(np.uint64)
    order = None
    while order is None or reached < depth:
        bits = max(1, int(rank.max(initial=0)).bit_length())
        if bits > 32:
            raise ValueError("a shard of more than 2**32 words")
        together = 64 // bits
        key = rank.copy()
        for k in range(1, together):
            key <<= np.uint64(bits)
            key[: max(0, n - k * reached)] |= rank[k * reached :]
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[1], key[1:] != key[:-1]])).astype(np.uint64)
        reached *= together
    return order, rank, reached


def _bisect(words: np.ndarray, order: np.ndarray, depth: int, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
    lo, hi = lo.copy(), hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) >> 1
        less = words[order[mid] + depth] < value[open_]
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


class Found:
    """Of one shard: for each suffix its longest match and one place; the distinct ranges of window occurrences."""

    def __init__(self, length: np.ndarray, place: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray, suffixes: np.ndarray, of: np.ndarray):
        self.length, self.place, self.starts, self.sizes, self.at, self.suffixes, self.of = length, place, starts, sizes, at, suffixes, of


class Shard:
    """The suffix array of some words. hashed: the words; ends: each document's end in them."""

    def __init__(self, hashed: np.ndarray, ends: np.ndarray, window: int, longest: int):
        position = np.arange(len(hashed)) + np.searchsorted(ends, np.arange(len(hashed)), side="right")  # a 0 stands after each document
        self.values, inverse = np.unique(hashed, return_inverse=True)
        self.ids = np.zeros(len(hashed) + len(ends) + longest + 1, np.int64)
        self.ids[position] = inverse + 1
        self.n = len(hashed) + len(ends)
        self.order, self.rank, self.depth = suffix_array(self.ids[: self.n], window)
        self.back = np.cumsum(self.ids[: self.n] != 0) - 1


def search(block: Block, shard: Shard) -> Found:
    """Binary-search all suffixes of the block in the suffix array of one shard. Places are positions in the shard's words."""
    order, depth, values = shard.order, shard.depth, shard.values
    slot = np.minimum(np.searchsorted(values, block.words), len(values) - 1)
    wanted = np.where(values[slot] == block.words, slot + 1, -1)
    n = len(block.item)
    length, place = np.zeros(n, np.int64), np.full(n, -1)
    who = np.flatnonzero(wanted[:n] > 0)
    lo, hi = np.zeros(len(who), np.int64), np.full(len(who), len(order))
    win_who, win_lo, win_hi = [], [], []
    d, reached, ahead = 0, depth, 8
    while len(who):
        value = wanted[who + d]
        new_lo = _bisect(shard.ids, order, d, lo, hi, value)
        new_hi = _bisect(shard.ids, order, d, new_lo, hi, value + 1)
        d += 1
        good = (new_lo < new_hi) & (value > 0)
        who, lo, hi = who[good], new_lo[good], new_hi[good]
        length[who], place[who] = d, order[lo]
        full = block.need[who] == d
        win_who.append(who[full])
        win_lo.append(lo[full])
        win_hi.append(hi[full])
        more = block.left[who] > d
        who, lo, hi = who[more], lo[more], hi[more]
        if d == reached and len(who):  # order what is still alive by further words, range by range
            first, one = np.unique(lo, return_index=True)
            size = hi[one] - first
            at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            some = order[at]
            far = np.concatenate([shard.rank, np.zeros(block.longest + depth + 1, np.uint64)])
            last = min(reached + (ahead - 1) * depth, depth * (int(block.left[who].max()) // depth))
            keys, ahead = [far[some + k] for k in range(last, reached - 1, -depth)], 2 * ahead
            order[at] = some[np.lexsort([*keys, np.repeat(np.arange(len(first)), size)])]
            reached += depth * len(keys)
    who, lo, hi = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (win_who, win_lo, win_hi))
    key = lo * (block.longest + 1) + block.need[who]
    _, one, of = np.unique(key, return_index=True, return_inverse=True)
    sizes = hi[one] - lo[one]
    at = np.repeat(lo[one] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return Found(length, np.where(place >= 0, shard.back[place], -1), shard.back[order[at]], sizes, np.repeat(block.need[who][one], sizes), who, of)


class Hits:
    """Hit words and items of the documents of one batch, over all blocks' shards."""

    def __init__(self, n_words: np.ndarray):
        self.n_words = n_words
        self.ends = np.cumsum(n_words)
        self.cover = np.zeros(int(self.ends[-1]) + 1 if len(n_words) else 1, np.int32)
        self.names: list[set[str]] = [set() for _ in n_words]
        self.longest = np.zeros(len(n_words), np.int64)

    def add(self, block: Block, shift: int, found: Found) -> None:
        starts = found.starts + shift
        np.add.at(self.cover, starts, 1)
        np.add.at(self.cover, starts + found.at, -1)
        doc = np.searchsorted(self.ends, starts, side="right")
        n_ranges = len(found.sizes)
        pair = np.unique(doc * max(1, n_ranges) + np.repeat(np.arange(n_ranges), found.sizes))
        doc, of = pair // max(1, n_ranges), pair % max(1, n_ranges)
        item = np.unique(found.of * len(block.names) + block.item[found.suffixes].astype(np.int64))
        rng, item = item // len(block.names), item % len(block.names)
        begin = np.searchsorted(rng, np.arange(n_ranges + 1))
        count = np.diff(begin)[of]
        at = np.repeat(begin[:-1][of] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        pair = np.unique(np.repeat(doc, count) * len(block.names) + item[at])
        for d, i in zip((pair // len(block.names)).tolist(), (pair % len(block.names)).tolist(), strict=True):
            self.names[d].add(block.names[i])
        ok = (found.place >= 0) & (found.length >= np.minimum(block.window, block.offset + block.left))
        np.maximum.at(self.longest, np.searchsorted(self.ends, found.place[ok] + shift, side="right"), found.length[ok])

    def n_hit(self) -> np.ndarray:
        hit = np.cumsum(np.cumsum(self.cover[:-1]) > 0)
        upto = np.concatenate([[0], hit])
        return upto[self.ends] - upto[self.ends - self.n_words] if len(self.ends) else self.ends


def scan(blocks: list[Block], texts: pa.Array) -> Hits:
    """Search a batch's texts in shards, each for all blocks."""
    hashed, counts = word_hashes(texts)
    hits = Hits(counts)
    blocks = [b for b in blocks if len(b.item)]
    if not blocks or not len(hashed):
        return hits
    most, longest = SHARD_BYTES // 4, max(b.longest for b in blocks)
    begin = hits.ends - counts
    for lo, hi in spans(counts, most):
        a, z = int(begin[lo]), int(hits.ends[hi - 1])
        for at in range(a, max(a + 1, z), most):  # more than one step for a single very long text only
            stop = min(z, at + most + longest)
            if stop > at:
                shard = Shard(hashed[at:stop], np.array([stop - at]) if hi - lo == 1 else hits.ends[lo:hi] - at, blocks[0].window, longest)
                for block in blocks:
                    hits.add(block, at, search(block, shard))
    return hits


def passes(benchmark: DataFrame, window: int = WINDOW, key: str = "item_id", text: str = "text") -> Iterator[list[Block]]:
    """The benchmark's distinct rows in blocks, as many at a time as one pass takes; each pass is read when it is needed."""
    rows = own_columns(benchmark, key, text).where(F.col(f"`{text}`").isNotNull()).toDF("k", "t").distinct()
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // PASS_BYTES)
    for i in range(n):
        part = rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == i).toArrow().combine_chunks()
        ids, texts = part.column(0).to_pylist(), part.column(1).combine_chunks() if part.num_rows else pa.array([], pa.string())
        yield [Block(ids[lo:hi], texts.slice(lo, hi - lo), window) for lo, hi in spans(byte_sizes(texts), BLOCK_BYTES)]


def _searched(docs: DataFrame, benchmark: DataFrame, text: str, window: int) -> DataFrame:
    """``docs`` by place (c0, c1, ...) with n_words, hit (runs of hit words, as pairs of 64-bit integers), items and longest."""
    sc, scratch = docs.sparkSession.sparkContext, Scratch(docs.sparkSession, "decontam")
    plain, column = [f"c{i}" for i in range(len(docs.columns))], f"c{docs.columns.index(text)}"
    more = [T.StructField("n_words", T.LongType()), T.StructField("hit", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.LongType())]
    rows = positional(docs)
    schema, names = T.StructType([*rows.schema, *more]), [*plain, *[f.name for f in more]]
    before = False
    for blocks in passes(benchmark, window):
        shared = sc.broadcast(blocks)  # bounded by PASS_BYTES
        rows = (scratch.put(rows) if before else rows).mapInArrow(_pass(shared, column, plain, names, before), schema)
        before = True
    return rows if before else rows.mapInArrow(_pass(sc.broadcast([]), column, plain, names, False), schema)


def _pass(shared, column: str, plain: list[str], names: list[str], before: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, column, 2 * SHARD_BYTES):
                hits = scan(shared.value, part.column(column))
                runs, found, longest = _runs(hits), hits.names, hits.longest
                if before:
                    runs = [a + b for a, b in zip(part.column("hit").to_pylist(), runs, strict=True)]
                    found = [{*a, *b} for a, b in zip(part.column("items").to_pylist(), found, strict=True)]
                    longest = np.maximum(longest, part.column("longest").to_numpy())
                cols = [pa.array(hits.n_words, pa.int64()), pa.array(runs, pa.binary()), pa.array([sorted(x) for x in found], pa.list_(pa.string())), pa.array(longest, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in plain), *cols], names)

    return run


def _runs(hits: Hits) -> list[bytes]:
    """Each text's hit words as [start, end) pairs."""
    hit = np.cumsum(hits.cover[:-1]) > 0
    edges = np.concatenate([[0], hits.ends])
    starts, ends = W.runs(hit, edges)
    owner = np.searchsorted(hits.ends, starts, side="right")
    first = np.searchsorted(owner, np.arange(len(hits.ends) + 1))
    base = hits.ends - hits.n_words
    both = np.stack([starts - base[owner], ends - base[owner]], 1) if len(starts) else np.zeros((0, 2), np.int64)
    return [both[first[i] : first[i + 1]].tobytes() for i in range(len(hits.ends))]


def _union(runs: bytes) -> list[tuple[int, int]]:
    """The union of [start, end) pairs, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, np.frombuffer(runs, np.int64).reshape(-1, 2).tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated, longest (words of the longest match found in the text, as one of the places of
    a benchmark suffix's longest match in its shard; 0 below the window), items (sorted ids) and spans (start and end words)."""
    rows = own_columns(docs, key, text)
    found = _searched(rows, benchmark, text, window)
    pair = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField(key, rows.schema[0].dataType), *[T.StructField(n, T.LongType()) for n in ("n_words", "n_hit", "n_items")], T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("longest", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", pair)])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            items = batch.column("items")
            hit = [_union(x) if x else [] for x in batch.column("hit").to_pylist()]
            n_hit = [sum(b - a for a, b in x) for x in hit]
            shas = [hashlib.sha256(",".join(x).encode()).hexdigest() if x else _NO_ITEMS for x in items.to_pylist()]
            runs = [[{"start": a, "end": b} for a, b in x] for x in hit]
            cols = [batch.column("c0"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pc.cast(pc.list_value_length(items), pa.int64()), pa.array(shas), pa.array([x > 0 for x in n_hit], pa.bool_()), batch.column("longest"), items, pa.array(runs, pair_kind)]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema])

    return found.drop("c1").mapInArrow(digest, schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows without any occurrence of a benchmark window, all columns unchanged. No shuffle."""
    found = _searched(docs, benchmark, text, window).where(F.size("items") == 0)
    return found.drop("n_words", "hit", "items", "longest").toDF(*docs.columns)


def longest_matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """For each item with a match of ``window`` words or more (or its whole text): item_id (as string), the longest match's words, its first word in the
    item, the document and the first word there; ties by the smaller document id, then places. Tasks send one row an item and shard."""
    rows = own_columns(docs, key, text).toDF("k", "t")
    sc, kind, scratch = docs.sparkSession.sparkContext, dict(rows.dtypes)["k"], Scratch(docs.sparkSession, "matches")
    names, out = "item_id string, n_words bigint, item_word bigint, k " + kind + ", doc_word bigint", None
    for blocks in passes(benchmark, window):
        shared = sc.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            longest = max((b.longest for b in shared.value), default=0)
            for batch in batches:
                for part in pieces(batch, "t", SHARD_BYTES):
                    hashed, counts = word_hashes(part.column("t"))
                    if not len(hashed):
                        continue
                    ends = np.cumsum(counts)
                    shard = Shard(hashed, ends, window, longest)
                    for block in shared.value:
                        found = search(block, shard)
                        ok = np.flatnonzero((found.place >= 0) & (found.length >= np.minimum(block.window, block.offset + block.left)))
                        ok = ok[np.lexsort([found.place[ok], block.offset[ok], -found.length[ok], block.item[ok]])]
                        ok = ok[np.unique(block.item[ok], return_index=True)[1]]
                        doc = np.searchsorted(ends, found.place[ok], side="right")
                        cols = [pa.array([block.names[i] for i in block.item[ok]], pa.string()), pa.array(found.length[ok]), pa.array(block.offset[ok].astype(np.int64)), part.column("k").take(pa.array(doc)), pa.array(found.place[ok] - (ends - counts)[doc])]
                        yield pa.RecordBatch.from_arrays(cols, ["item_id", "n_words", "item_word", "k", "doc_word"])

        one = scratch.put(rows.mapInArrow(run, names))  # a pass is read to its end before the next begins
        out = one if out is None else out.unionByName(one)
    out = docs.sparkSession.createDataFrame([], names) if out is None else out
    best = F.min(F.struct((-F.col("n_words")).alias("n"), "k", "item_word", "doc_word")).alias("b")
    return out.groupBy("item_id").agg(best).select("item_id", (-F.col("b.n")).alias("n_words"), "b.item_word", F.col("b.k").alias(key), "b.doc_word")
