"""Near-duplicates at a similarity of word shingles, by ball hashing of long SimHash fingerprints.

Two texts are alike if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. A fingerprint of 64 bits cannot tell this: at 0.8 a bit differs with
probability acos(2J / (1 + J)) / pi = 0.151, so about ten of 64 do. Here the fingerprint has several blocks; two texts are candidates if some
block differs in at most ``radius`` bits, and these are found as meet-in-the-middle: each block stands for all its variants within half the radius,
and blocks with a common variant are exactly those. Wider blocks keep chance meetings rare in larger tables, and more of them keep the share of pairs that is
found (``layout``). Fingerprints of few shingles differ in more bits, so short texts decide how many: of pairs at a similarity of 0.8, 8 blocks of 32 bits find 0.90 of
texts of 8 words and 0.98 or more from 12 words on, 32 of 40 bits 0.97 and 0.99, 64 of 48 bits 0.92 and 0.99; of likelier pairs nearly all.

The shuffle goes by the leading bits of a block: it is sent once to each prefix that some variant of it has, and the task that holds a prefix makes the
remaining variants there, sorts them and verifies what collides by 64 bits of another block. All members of a collision are compared unless they are linked already,
so a group of many copies costs about its size; of the links each task keeps the tree with the nearest pairs. Links are then verified by the whole fingerprint; those
within SURE of its bits stand, and those farther apart that would join two groups are verified by the exact similarity of their shingle sets.

Definitions. Words are runs of other bytes than ASCII blanks, ASCII capitals lower-cased; a text of fewer than five words is one shingle. Null text counts as empty; texts
without words are alike. Shingles are compared by 64-bit hashes. Equal fingerprints are one node, so exact copies cost one row. Every input row gives one
output row; an empty table gives an empty result; extra columns are ignored. Very long texts are hashed in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import words as W
from brindle.llm.components import components, local_components
from brindle.llm.shared import Scratch, flat, own_columns, pieces
from brindle.llm.simhash import masks

WORDS, LEAST, RADIUS = 5, 0.8, 4
#: Shares of the fingerprint's bits: links within SURE stand without a look at the texts, links beyond FAR are no candidates. At a similarity of 0.8 the
#: share is 0.151 with a deviation of 0.022 for 256 bits.
SURE, FAR, CHECK_BITS = 0.08, 0.25, 22
#: Rows of one prefix, and variants worked on at a time.
PREFIX_ROWS, VARIANTS = 1 << 22, 1 << 21
#: Longest run of equal variants whose members are compared together with those of other runs.
SHORT = 64
_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def layout(rows: int) -> tuple[int, int]:
    """(blocks, bits of a block) at which a text meets few others by chance, and 0.9 or more of the pairs at 0.8 are found from 8 words on."""
    return (8, 32) if rows <= 1 << 25 else (32, 40) if rows <= 1 << 31 else (64, 48)


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def shingles(texts: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text one after another, and how many each has."""
    data, offsets = flat(texts)
    n = len(texts)
    if n == 1 and len(data) > W.PART:
        hashed = np.concatenate([h for _, h in W.long_text(data, _WORD)])
        count = np.array([len(hashed)])
    else:
        low = W.LOWER[data]
        starts, ends = W.runs(_WORD[low], offsets)
        hashed = W.hashes(low, starts, ends)
        count = np.bincount(W.owners(offsets, starts), minlength=n)
    end = np.cumsum(count)
    own = np.maximum(np.minimum(count, 1), count - size + 1)  # shingles of a text
    doc = np.repeat(np.arange(n), own)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(own) - own, own) + (end - count)[doc]
    h = np.zeros(len(doc), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            inside = at + k < end[doc]
            h[inside] = (h[inside] ^ (hashed[at[inside] + k] >> np.uint64(3))) * _STEP[k % 5] + hashed[at[inside] + k]
    h = _mixed(h, -1)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=n)


def wide(texts: pa.Array, words: int) -> np.ndarray:
    """Fingerprints of 64 * ``words`` bits, a row of unsigned words for each text: the majority of the bits of its shingles, zero without any."""
    hashed, count = shingles(texts)
    ones = np.zeros((len(count), 64 * words), np.int64)
    doc = np.repeat(np.arange(len(count)), count)
    for lo in range(0, len(hashed), 1 << 16):
        part = np.stack([_mixed(hashed[lo : lo + (1 << 16)], j) for j in range(words)], 1)
        bits = np.unpackbits(part.astype(">u8").view(np.uint8), axis=1)
        who = doc[lo : lo + (1 << 16)]
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        ones[who[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > count[:, None], axis=1).view(">u8").astype(np.uint64)


def blocks_of(fps: np.ndarray, blocks: int, width: int) -> np.ndarray:
    """The blocks' values, a row for each fingerprint."""
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8), axis=1)[:, : blocks * width].reshape(len(fps), blocks, width)
    padded = np.zeros((len(fps), blocks, 64), np.uint8)
    padded[:, :, 64 - width :] = bits
    return np.packbits(padded, axis=2).view(">u8")[:, :, 0].astype(np.uint64)


def fingerprints(docs: DataFrame, blocks: int, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, text_hash, node (a hash of the fingerprint), fp and blocks of each row; one pass over the texts, no shuffle."""
    rows = own_columns(docs, key, text).toDF("k", "t").withColumn("text_hash", F.xxhash64("t"))
    schema, words = f"k {dict(rows.dtypes)['k']}, text_hash bigint, fp array<bigint>, blocks array<bigint>", -(-blocks * width // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t", W.PART):
                found = wide(part.column("t"), words)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.view(np.int64).ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (found, blocks_of(found, blocks, width))]
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("text_hash"), *lists], ["k", "text_hash", "fp", "blocks"])

    return rows.mapInArrow(run, schema).withColumn("node", F.xxhash64("fp"))


def forest(n: int, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which of the links a-b make up the forest of least distances (every group joined by its nearest pairs)."""
    weight = np.lexsort((b, a, far)).argsort()  # ties broken, so that no circle arises
    root, left, chosen = np.arange(n), np.arange(len(a)), []
    while len(left):
        best = np.full(n, len(a))
        np.minimum.at(best, root[a[left]], weight[left])
        np.minimum.at(best, root[b[left]], weight[left])
        take = np.unique(best[best < len(a)])
        mine = left[np.isin(weight[left], take)]
        chosen.append(mine)
        done = np.concatenate(chosen)
        root = local_components(n, a[done], b[done])
        left = left[root[a[left]] != root[b[left]]]
    return np.concatenate(chosen) if chosen else left


def _by_value(values: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Both sorted by value, then owner (below n): as one number where it fits 64 bits."""
    bits = np.uint64(max(1, (n - 1).bit_length()))
    if len(values) and int(values.max()).bit_length() + int(bits) > 64:
        order = np.lexsort((owners, values))
        return values[order], owners[order]
    both = (values.astype(np.uint64) << bits) | owners.astype(np.uint64)
    both.sort()
    return both >> bits, (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def met(values: np.ndarray, owners: np.ndarray, check: np.ndarray, most: int = CHECK_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (a, b, distance) among owners of equal values, verified by their check bits. Neighbours in a run are compared, then all of its members that are not linked.

    In large tables nearly every owner is in some short run by chance, so these are compared together, distance by distance of places; only runs longer than SHORT
    are looked at one by one."""
    values, owners = _by_value(values, owners, len(check))
    equal = values[1:] == values[:-1]
    same = np.flatnonzero(equal & (owners[1:] != owners[:-1]))
    a, b = owners[same], owners[same + 1]
    near = np.flatnonzero(np.bitwise_count(check[a] ^ check[b]) <= most)
    pair = np.unique(a[near] * len(check) + b[near])
    a, b = pair // len(check), pair % len(check)
    more = [[a], [b], [np.bitwise_count(check[a] ^ check[b]).astype(np.int64)]]
    if not (equal[1:] & equal[:-1]).any():  # no run of three
        return tuple(x[0] for x in more)
    root, known = np.arange(len(check)), np.unique(np.concatenate([a, b]))
    root[known] = known[local_components(len(known), np.searchsorted(known, a), np.searchsorted(known, b))]

    def keep(one: np.ndarray, two: np.ndarray) -> None:
        d = np.bitwise_count(check[one] ^ check[two])
        good = (d <= most) & (root[one] != root[two])
        for out, found in zip(more, (np.minimum(one, two)[good], np.maximum(one, two)[good], d[good]), strict=True):
            out.append(found.astype(np.int64))

    edge = np.flatnonzero(np.concatenate([[True], ~equal, [True]]))
    size = np.diff(edge)
    own = np.flatnonzero(size > 2)
    begin, size = edge[:-1][own], size[own]
    group = root[owners[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]]
    first = np.cumsum(size) - size
    parted = np.minimum.reduceat(group, first) != np.maximum.reduceat(group, first)
    for gap in range(2, SHORT):
        run, left = begin[parted & (size <= SHORT) & (size > gap)], size[parted & (size <= SHORT) & (size > gap)] - gap
        if not len(run):
            break
        at = np.repeat(run - np.cumsum(left) + left, left) + np.arange(left.sum())
        keep(owners[at], owners[at + gap])
    for x, n in zip(begin[parted & (size > SHORT)].tolist(), size[parted & (size > SHORT)].tolist(), strict=True):
        member = owners[x : x + n]
        group = root[member]
        main = group == np.bincount(group).argmax()
        keep(*(g.ravel() for g in np.meshgrid(member[~main], member, indexing="ij")))  # all outside the largest group against all
    return tuple(np.concatenate(x) for x in more)


def links(nodes: DataFrame, width: int, radius: int = RADIUS, prefix_bits: int | None = None, most: int = CHECK_BITS) -> DataFrame:
    """u, v: candidate links between nodes (node, fp, blocks), some block within ``radius`` bits and the check word within ``most``."""
    if radius % 2:
        raise ValueError("the radius must be even: each side flips half of it")
    reach = radius // 2
    if prefix_bits is None:
        n = nodes.count()
        prefix_bits = next(p for p in range(5, width) if n * len(masks(p, reach)) >> p <= PREFIX_ROWS)
    low = width - prefix_bits
    flips = F.explode(F.array(*[F.lit(m) for m in masks(prefix_bits, reach)]))
    each = nodes.select("node", "fp", F.posexplode("blocks").alias("b", "value"))
    word = F.pmod(F.floor(F.col("b") * width / 64) + 2, F.size("fp")).cast("int")  # apart from the block's own bits
    each = each.select("node", "b", "value", F.get("fp", word).alias("word"), flips.alias("m"))
    sent = each.select((F.shiftleft(F.col("b").cast("long"), prefix_bits) + F.shiftright("value", low).bitwiseXOR(F.col("m"))).alias("p"), "value", "node", "word")

    def group(p: int, value: np.ndarray, node: np.ndarray, check: np.ndarray) -> pa.RecordBatch:
        flipped = np.bitwise_count((value >> np.uint64(low)) ^ np.uint64(p))
        total = sum(int(np.count_nonzero(flipped == r)) * len(masks(low, reach - r)) for r in range(reach + 1))
        more = min(low - 2, max(0, (total // VARIANTS).bit_length()))  # work on as many parts of the prefix as memory asks for
        rest, found = low - more, []
        for s in range(1 << more):
            gone = np.bitwise_count((value >> np.uint64(rest)) ^ np.uint64(p << more | s))
            variants, owners = [], []
            for r in range(reach + 1):
                who = np.flatnonzero(gone == r)
                if len(who):
                    m = np.array(masks(rest, reach - r), np.uint64)
                    variants.append(((value[who] & np.uint64((1 << rest) - 1))[:, None] ^ m[None, :]).ravel())
                    owners.append(np.repeat(who, len(m)))
            if variants:
                found.append(met(np.concatenate(variants), np.concatenate(owners), check, most))
        a, b, far = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
        tree = forest(len(value), a, b, far)
        return pa.RecordBatch.from_arrays([pa.array(node[np.minimum(a, b)[tree]]), pa.array(node[np.maximum(a, b)[tree]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # rows come sorted by prefix; those of the last one so far
        mask = np.uint64((1 << prefix_bits) - 1)

        def whole(p: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1], [True]]))
            for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                yield group(int(np.uint64(p[x]) & mask), *(c[x:y] for c in columns))

        for batch in batches:
            now = tuple(batch.column(c).to_numpy().view(t) for c, t in (("p", np.int64), ("value", np.uint64), ("node", np.int64), ("word", np.uint64)))
            if held and now[0][-1] != held[-1][0][-1]:
                cut = int(np.searchsorted(now[0], now[0][-1]))
                yield from whole(*(np.concatenate(c) for c in zip(*held, tuple(c[:cut] for c in now), strict=True)))
                held = [tuple(c[cut:] for c in now)]
            else:
                held.append(now)
        if held:
            yield from whole(*(np.concatenate(c) for c in zip(*held, strict=True)))

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(parts, "p").sortWithinPartitions("p").mapInArrow(run, "u bigint, v bigint").distinct()


def alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, least: float = LEAST) -> DataFrame:
    """The pairs u, v whose shingle sets have a Jaccard similarity of ``least`` or more. Only texts of nodes that occur in a pair are read again."""
    wanted = nodes.join(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node").select("node", "text_hash")
    texts = own_columns(docs, text).toDF("t").withColumn("text_hash", F.xxhash64("t")).join(wanted, "text_hash").select("node", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t", W.PART):
                found, count = shingles(part.column("t"))
                edges = np.concatenate([[0], np.cumsum(count)])
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.LargeListArray.from_arrays(pa.array(edges), pa.array(found.view(np.int64))).cast(pa.list_(pa.int64()))], ["node", "s"])

    sets = texts.mapInArrow(run, "node bigint, s array<bigint>").groupBy("node").agg(F.first("s").alias("s"))
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common >= F.lit(least) * (F.size("a") + F.size("b") - common)).select("u", "v")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None, least: float = LEAST, radius: int = RADIUS, size: tuple[int, int] | None = None) -> DataFrame:
    """key, component_id (the least key of those reachable by links), text_hash and root (the component's least node) of each row."""
    scratch = scratch or Scratch(docs.sparkSession, "similar")
    blocks, width = size or layout(docs.count())
    rows = scratch.put(fingerprints(docs, blocks, width, key, text))
    nodes = scratch.put(rows.groupBy("node").agg(F.min("k").alias("k"), F.min("text_hash").alias("text_hash"), F.first("fp").alias("fp"), F.first("blocks").alias("blocks")))
    fps = nodes.select("node", "fp")
    found = links(nodes, width, radius)
    pairs = found.join(fps.select(F.col("node").alias("u"), F.col("fp").alias("a")), "u").join(fps.select(F.col("node").alias("v"), F.col("fp").alias("b")), "v")
    bits = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x) / F.lit(64 * -(-blocks * width // 64))
    pairs = scratch.put(pairs.select("u", "v", bits.alias("far")).where(F.col("far") <= FAR))
    sure = scratch.put(components(scratch.put(pairs.where(F.col("far") <= SURE).select("u", "v")), scratch))
    named = pairs.where(F.col("far") > SURE)
    for c in ("u", "v"):
        named = named.join(sure.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left")
    open_ = scratch.put(named.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v"))
    edges = sure.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    tree = scratch.put(components(scratch.put(edges.unionByName(alike(open_, nodes, docs, text, least))), scratch))
    member = nodes.select("node", "k").join(tree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_key = member.groupBy("root").agg(F.min("k").alias("component_id"))
    label = scratch.put(member.select("node", "root").join(least_key, "root"))
    return rows.select("k", "node", "text_hash").join(label, "node").select(F.col("k").alias(key), "component_id", "text_hash", "root")
