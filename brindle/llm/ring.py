"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2**16 cells. Each shard stands at ``vnodes`` places of it, which depend on the shard's number alone, so one more shard changes no other
place. A row lies in the cell of its text's hash and belongs to the next place clockwise. A shard holds at most
(1 + slack) of the mean load, in bytes; what a full shard cannot hold continues clockwise to the next shard with room.

Groups of equal texts that have over 1/GRAIN of a shard are placed first and whole, the largest first; one that fits nowhere goes to the shard with the least
load, and only one larger than a shard is parted. What is left, all smaller than that, fills the shards up to one level: so a load exceeds
the bound by 1/GRAIN of a shard for each cut that borders it, or by one large group that no shard had room for.

What is placed by the driver are sums, never rows: 2**16 cells, GRAIN groups a shard at most, and the sub-cells into which those with very many rows are
dealt by a hash of the key, 10,000 in all. Rows of a cell are then ordered, and a running sum of bytes tells each its shard. Equal texts share a
cell and stay together.

Null text has no bytes and counts as empty, so it shares the empty text's cell. Null keys sort first. Repeated rows are
placed one by one. An empty table gives an empty result. Extra columns are ignored. All steps on rows are DataFrame expressions.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.shared import Scratch, own_columns

CELL_BITS, OVERHEAD = 16, 16
SUBCELL_ROWS, SUBCELLS = 500, 10_000
GRAIN = 256


class Ring:
    """Places of all shards, clockwise, and for each place the order in which shards follow."""

    def __init__(self, shards: int, vnodes: int = 64):
        if shards < 1 or vnodes < 1:
            raise ValueError("a ring needs shards and places")
        self.shards = shards
        places = sorted((int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:2], "big") >> (16 - CELL_BITS), s) for s in range(shards) for v in range(vnodes))
        self.at = np.array([p for p, _ in places])
        self.shard = [s for _, s in places]

    def place(self, cell: int) -> int:
        i = int(np.searchsorted(self.at, cell))
        return i if i < len(self.at) else 0

    def following(self, place: int) -> list[int]:
        """Every shard once, in clockwise order from a place."""
        n = len(self.shard)
        return list(dict.fromkeys(self.shard[(place + k) % n] for k in range(n)))

    def assign(self, large: list[tuple[int, int, int, int]], loose: list[tuple[int, int, int]], slack: float) -> list[tuple[int, int, int, int, int]]:
        """Pieces (cell, sub-cell, from, to, shard) of all units.

        large: (cell, sub-cell, bytes, step), which are parted at multiples of their step only, those of the largest step first. loose: (cell, sub-cell, bytes),
        which are parted anywhere, in clockwise order. Every shard first keeps what is its own, as far as it has room; the rest goes on clockwise."""
        rest = sum(b for _, _, b in loose)
        bound = self.bound(sum(b for _, _, b, _ in large) + rest, slack)
        load, pieces, order = [0] * self.shards, [], {}

        def clockwise(cell: int) -> list[int]:
            place = self.place(cell & ((1 << CELL_BITS) - 1))
            if place not in order:
                order[place] = self.following(place)
            return order[place]

        def give(cell: int, sub: int, at: int, size: int, step: int, level: int, to: list[int]) -> int:
            for s in to:
                take = min(size - at, max(0, level - load[s]) // step * step)
                if take:
                    pieces.append((cell, sub, at, at + take, s))
                    load[s] += take
                    at += take
                if at == size:
                    break
            return at

        for cell, sub, size, step in sorted(large, key=lambda u: (-u[3], u)):
            at = give(cell, sub, 0, size, step, bound, clockwise(cell))
            while at < size:  # no shard has room
                least = min(clockwise(cell), key=load.__getitem__)
                pieces.append((cell, sub, at, at + step, least))
                load[least] += step
                at += step
        full = sorted(load)  # raise the level from the emptiest shard up until all that is left has room
        k = next((k for k in range(1, self.shards) if rest <= k * full[k] - sum(full[:k])), self.shards)
        level = max(bound, -(-(rest + sum(full[:k])) // k))
        kept = [(cell, sub, give(cell, sub, 0, size, 1, level, clockwise(cell)[:1]), size) for cell, sub, size in loose]
        for cell, sub, at, size in kept:
            give(cell, sub, at, size, 1, level, clockwise(cell))
        return pieces

    def bound(self, total: int, slack: float) -> int:
        return -(-int(total * (1 + slack)) // self.shards) + 1


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", vnodes: int = 64, slack: float = 0.0002, scratch: Scratch | None = None) -> DataFrame:
    """key, size (UTF-8 bytes + 16), text_crc32, shard, slot (0, 1, ... within the shard)."""
    scratch, ring = scratch or Scratch(docs.sparkSession, "ring"), Ring(shards, vnodes)
    spark = docs.sparkSession
    own = own_columns(docs, key, text).toDF("k", "t").withColumn("t", F.coalesce("t", F.lit("")))
    rows = scratch.put(own.select("k", (F.octet_length("t") + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(F.col("t").cast("binary")).alias("crc"), F.xxhash64("t").alias("h")))

    groups = scratch.put(rows.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bound, most = ring.bound(total, slack), max(SUBCELL_ROWS, -(-n // SUBCELLS))
    large = groups.where(F.col("bytes") > total // (shards * GRAIN)).orderBy("h").collect()  # GRAIN * shards rows at most
    # A large group has a cell number of its own, whose low bits are those of the ring's cell.
    marks = [(r["h"], (i + 1) << CELL_BITS | (r["h"] & (2**64 - 1)) >> (64 - CELL_BITS), -(-r["n"] // most)) for i, r in enumerate(large)]
    few = spark.createDataFrame(marks or [(None, None, None)], "h bigint, own bigint, parts bigint")
    rows = rows.join(F.broadcast(few), "h", "left").withColumn("cell", F.coalesce("own", F.shiftrightunsigned("h", 64 - CELL_BITS)))
    rows = rows.withColumn("sub", F.coalesce(F.pmod(F.xxhash64("k", "size", F.lit("sub")), F.col("parts")), F.lit(0)).cast("int")).drop("own", "parts")
    sums = [tuple(r) for r in rows.groupBy("cell", "sub").agg(F.sum("size")).collect()]  # 2**CELL_BITS + GRAIN * shards + SUBCELLS rows at most
    whole = {m[1]: r["bytes"] for m, r in zip(marks, large, strict=True) if r["bytes"] <= bound or r["n"] == 1}
    step = {m[1]: r["bytes"] // r["n"] for m, r in zip(marks, large, strict=True)}  # equal texts are of one size
    units = [(cell, 0, size, size) for cell, size in whole.items()] + [(*u, step[u[0]]) for u in sums if u[0] in step and u[0] not in whole]
    pieces = ring.assign(units, sorted(u for u in sums if u[0] not in step), slack)
    home = {p[0]: p[4] for p in pieces if p[0] in whole}
    pieces = [p for p in pieces if p[0] not in whole] + [(cell, sub, 0, size, home[cell]) for cell, sub, size in sums if cell in whole]

    here = Window.partitionBy("cell", "sub").orderBy("h", F.col("k").asc_nulls_first(), "size")
    rows = rows.withColumn("n", F.row_number().over(here)).withColumn("upto", F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    together = F.min("upto").over(Window.partitionBy("cell", "sub", "h"))  # the groups of a plain cell stay together
    rows = rows.withColumn("at", F.when(F.col("cell") < 1 << CELL_BITS, together).otherwise(F.col("upto")))
    parts = spark.createDataFrame([(i, *p[:4]) for i, p in enumerate(pieces)] or [(-1, -1, 0, 0, 0)], "piece int, cell bigint, sub int, lo bigint, hi bigint")
    placed = rows.join(F.broadcast(parts), ["cell", "sub"]).where("at >= lo AND at < hi")  # one piece a unit and some cuts
    placed = scratch.put(placed.select("k", "size", "crc", "n", "piece"))

    runs = sorted((pieces[r["piece"]][4], r["piece"], r["first"], r["count"]) for r in placed.groupBy("piece").agg(F.min("n").alias("first"), F.count("*").alias("count")).collect())
    starts, at = [], [0] * shards
    for s, piece, first, count in runs:
        starts.append((piece, s, at[s] - first))
        at[s] += count
    base = spark.createDataFrame(starts or [(-1, 0, 0)], "piece int, shard int, base bigint")
    out = placed.join(F.broadcast(base), "piece")
    return out.select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("base") + F.col("n")).alias("slot"))
