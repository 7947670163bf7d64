"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most r bits exactly if some value lies within r/2 bits of both. So every distinct fingerprint
stands for all variants in its ball of radius r/2 (2,081 for r = 4), and fingerprints with a common variant are linked. The shuffle
goes by the leading bits of the variants (16, more beyond 125 million fingerprints): one is sent once to each prefix that some variant of it has (137 for 16 bits), and the
task that holds a prefix makes the remaining variants there, sorts them and keeps what collides. All who share a variant are
within r of each other, so linking them to the least one loses nothing, and no group is expanded into pairs.

A prefix with very many fingerprints (more than ``hot`` variants) is dealt out by whole variants instead; at most 2,081 distinct
fingerprints can share one.

Definitions. Null text counts as empty. No words: fingerprint 0, linked like any other. Equal fingerprints are one node, so exact
copies cost one row. component_id is the least non-null doc_id reachable; null only if all ids of the component are null.
Every input row gives one output row, repeated rows included. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.components import components, local_components
from brindle.llm.shared import Scratch, own_columns, positional, raw

SEED, SHINGLE, RADIUS, PREFIX_BITS, HOT_VARIANTS = 42, 4, 4, 16, 8_000_000
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, size: int = SHINGLE, block: int = 1 << 20) -> int:
    """Majority of the bits of the shingles' XXH64, over the whole text, in blocks of bounded memory."""
    from xxhash import xxh64_digest

    ones, total, at, carry = np.zeros(64, np.int64), 0, 0, []
    while at < len(text):
        end = at + block
        if end < len(text):
            m = _BLANK.search(text, end)
            end = m.start() if m else len(text)
        words = carry + text[at:end].lower().split()
        at = end
        if len(words) >= size:
            digests = np.frombuffer(b"".join([xxh64_digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))]), np.uint8).reshape(-1, 8)
            total += len(digests)
            if len(digests) < 200:
                ones += np.unpackbits(digests, axis=1).sum(0, dtype=np.int64)
            else:
                for k in range(8):
                    ones[8 * k : 8 * k + 8] += np.bincount(digests[:, k], minlength=256) @ _BITS
        carry = words[-(size - 1) :] if len(words) >= size else words
    if not total:
        if not carry:
            return 0
        return int.from_bytes(xxh64_digest(b" ".join(carry), SEED), "big")
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp (the fingerprint's 64 bits as a long) and text_hash of each row; one pass over the texts, no shuffle."""
    rows = own_columns(docs, key, text).withColumn("text_hash", F.xxhash64(text))
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = np.array([fingerprint(t or b"") for t in raw(part.column(text))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(found), part.column("text_hash")], [key, "fp", "text_hash"])

    return rows.mapInArrow(run, f"`{key}` {kind}, fp bigint, text_hash bigint")


def masks(bits: int, radius: int) -> list[int]:
    """All values of ``bits`` bits with at most ``radius`` ones."""
    return [sum(1 << b for b in chosen) for k in range(radius + 1) for chosen in combinations(range(bits), k)]


@cache
def _low_masks(bits: int, radius: int) -> np.ndarray:
    return np.array(masks(bits, radius), np.uint64)


def collisions(prefix: np.ndarray, fps: np.ndarray, low_bits: int, reach: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints sent to some prefixes, as a star for each group that meets there, each verified."""
    low = np.uint64((1 << low_bits) - 1)
    base = (prefix.astype(np.uint64) << np.uint64(low_bits)) | (fps & low)
    flipped = np.bitwise_count((fps >> np.uint64(low_bits)) ^ prefix.astype(np.uint64))
    variants, owners = [], []
    for k in range(reach + 1):
        who = np.flatnonzero(flipped == k)
        if len(who):
            m = _low_masks(low_bits, reach - k)
            variants.append((base[who, None] ^ m[None, :]).ravel())
            owners.append(np.repeat(who, len(m)))
    values, owners = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(values)
    values, owners = values[order], owners[order]
    same = values[1:] == values[:-1]
    if not same.any():
        return fps[:0], fps[:0]
    at = np.flatnonzero(same)
    first, second = owners[at], owners[at + 1]  # a chain through each run of equal variants
    true = np.bitwise_count(fps[first] ^ fps[second]) <= radius
    first, second = first[true], second[true]
    root = local_components(len(fps), first, second)
    linked = np.unique(np.concatenate([first, second]))
    linked = linked[root[linked] != linked]
    return fps[root[linked]], fps[linked]


def prefix_bits_for(n: int, radius: int = RADIUS, hot: int = HOT_VARIANTS) -> int:
    """Prefix length at which n fingerprints make about half of ``hot`` variants a prefix: 16 bits up to 125 million, 25 for 50 billion (326 prefixes each)."""
    return min(40, max(PREFIX_BITS, (2 * n * len(masks(64, radius // 2)) // max(1, hot)).bit_length()))


def links(distinct: DataFrame, scratch: Scratch, radius: int = RADIUS, prefix_bits: int | None = None, hot: int = HOT_VARIANTS) -> DataFrame:
    """Edges u, v between distinct fingerprints (column fp) that join exactly those that are linked within ``radius`` bits."""
    if radius % 2:
        raise ValueError("the radius must be even: each side flips half of it")
    prefix_bits = prefix_bits or prefix_bits_for(distinct.count(), radius)
    reach, low_bits = radius // 2, 64 - prefix_bits
    sizes = [len(masks(low_bits, reach - k)) for k in range(reach + 1)]
    flips = masks(prefix_bits, reach)

    own = F.shiftrightunsigned("fp", low_bits)
    counts = distinct.groupBy(own.alias("p")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(sizes[m.bit_count()]).alias("w")) for m in flips])).alias("f")
    sent = distinct.select("fp", F.explode(F.array(*[F.lit(m) for m in flips])).alias("m")).select(own.bitwiseXOR(F.col("m")).alias("p"), "fp")
    if prefix_bits <= PREFIX_BITS:
        load = np.zeros(1 << prefix_bits, np.int64)
        found = counts.collect()  # at most 2**PREFIX_BITS rows
        at, n = (np.array([r[i] for r in found], np.int64) for i in (0, 1))
        for m in flips:
            load[at ^ m] += n * sizes[m.bit_count()]
        crowded = np.flatnonzero(load > hot).tolist()
        few = F.broadcast(distinct.sparkSession.createDataFrame([(p,) for p in crowded], "p long")) if crowded else None  # at most 2**PREFIX_BITS rows
    else:
        loads = counts.select("p", "n", each).groupBy(F.col("p").bitwiseXOR(F.col("f.m")).alias("p")).agg(F.sum(F.col("n") * F.col("f.w")).alias("load"))
        few = scratch.put(loads.where(F.col("load") > hot).select("p"))
        few = None if few.isEmpty() else few
    spread = None
    if few is not None:
        spread, sent = sent.join(few, "p", "left_semi"), sent.join(few, "p", "left_anti")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by prefix; whole prefixes are worked on together, some 2 million variants at a time."""
        weight = np.array(sizes)

        def found(p: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            u, v = collisions(p, f, low_bits, reach, radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        kept_p, kept_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            p = np.concatenate([kept_p, batch.column("p").to_numpy().astype(np.int64)])
            f = np.concatenate([kept_f, batch.column("fp").to_numpy().view(np.uint64)])
            cost = np.cumsum(weight[np.bitwise_count((f >> np.uint64(low_bits)) ^ p.astype(np.uint64))])
            starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            lo = 0
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if cost[e - 1] - (cost[lo - 1] if lo else 0) > 2_000_000 and s > lo:
                    yield found(p[lo:s], f[lo:s])
                    lo = s
            last = int(starts[-1]) if len(starts) else 0
            if last > lo:
                yield found(p[lo:last], f[lo:last])
                lo = last
            kept_p, kept_f = p[lo:].copy(), f[lo:].copy()
        if len(kept_f):
            yield found(kept_p, kept_f)

    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = sent.repartition(parts, "p").sortWithinPartitions("p").mapInArrow(meet, "u bigint, v bigint")
    if spread is not None:
        free = F.lit(reach) - F.bit_count(own.bitwiseXOR(F.col("p")))
        cases = F.when(free == 0, F.array(F.lit(0)))
        for k in range(1, reach + 1):
            cases = cases.when(free == k, F.array(*[F.lit(m) for m in masks(low_bits, k)]))
        base = F.shiftleft(F.col("p"), low_bits).bitwiseOR(F.col("fp").bitwiseAND(F.lit((1 << low_bits) - 1)))
        one = spread.select("fp", base.alias("b"), F.explode(cases).alias("m")).select("fp", F.col("b").bitwiseXOR(F.col("m")).alias("x"))
        one = scratch.put(one)
        least = one.groupBy("x").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n")
        star = one.join(least, "x").where("fp <> u").select("u", F.col("fp").alias("v"))
        edges = edges.unionByName(star.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius))
    return edges.distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None, **options) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id, text_hash and root (the component's least fingerprint as a long) of each row."""
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    rows = scratch.put(fingerprints(docs, key, text).withColumnRenamed(key, "k"))
    distinct = scratch.put(rows.groupBy("fp").agg(F.min("k").alias("k")))
    tree = scratch.put(components(scratch.put(links(distinct, scratch, **options)), scratch))
    member = distinct.join(tree, distinct.fp == tree.node).select("fp", "root", "k")
    least = member.groupBy("root").agg(F.min("k").alias("component_id"))
    found = scratch.put(tree.join(least, "root").select(F.col("node").alias("fp"), "component_id", "root"))
    alone = distinct.join(found, "fp", "left_anti").select("fp", F.col("k").alias("component_id"), F.col("fp").alias("root"))
    label = scratch.put(found.unionByName(alone))
    return rows.join(label, "fp").select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash", "root")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", find=near_duplicates, **options) -> DataFrame:
    """The input rows of one document of each component that ``find`` gives: that with the component's least id; all columns, unchanged.

    Rows are told apart by (key, hash of the text), null equal to null. Where several kept rows agree in both, one stays; these
    few go through a second, small branch, so the others are joined once without any grouping of texts. A component whose ids are all
    null keeps the row with the least text hash."""
    scratch = Scratch(docs.sparkSession, "keep")
    found = scratch.put(find(docs, key, text, scratch, **options))
    named = found.where(F.col(key) == F.col("component_id")).groupBy(F.col("component_id").alias("g"), "root").agg(F.min("text_hash").alias("h"), F.count("*").alias("n"))
    named = named.select(F.col("g").alias("k"), "h", "n")
    bare = found.where(F.col("component_id").isNull()).select(F.col("text_hash").alias("h"))
    if bare.isEmpty():
        kept = scratch.put(named)
    else:
        kept = scratch.put(named.unionByName(_one_of_bare(bare, docs, key, text, scratch, find, **options)))
    at = {name: f"c{docs.columns.index(name)}" for name in (key, text)}
    same = F.col(f"d.{at[key]}").eqNullSafe(F.col("w.k")) & (F.xxhash64(F.col(f"d.{at[text]}")) == F.col("w.h"))
    rows = positional(docs).alias("d")
    out = rows.join(kept.where("n = 1").alias("w"), same, "left_semi")
    if not kept.where("n > 1").isEmpty():
        again = rows.join(kept.where("n > 1").alias("w"), same, "left_semi").withColumn("h", F.xxhash64(at[text]))
        out = out.unionByName(again.dropDuplicates([at[key], "h"]).drop("h"))
    return out.toDF(*docs.columns)


def _one_of_bare(bare: DataFrame, docs: DataFrame, key: str, text: str, scratch: Scratch, find, **options) -> DataFrame:
    """Components without any id: rerun their rows with the text hash as the id and keep the least."""
    rows = docs.where(F.col(f"`{key}`").isNull()).select(F.xxhash64(f"`{text}`").alias("id"), F.col(f"`{text}`").alias("t"))
    rows = rows.join(bare.select(F.col("h").alias("id")).distinct(), "id", "left_semi")
    again = find(rows, "id", "t", scratch, **options).where("id = component_id").select("id").distinct()
    kind = dict(docs.dtypes)[key]
    return again.select(F.lit(None).cast(kind).alias("k"), F.col("id").alias("h"), F.lit(2).cast("long").alias("n"))
