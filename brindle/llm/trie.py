"""The prefix trie of conversations as preorder intervals.

Every distinct sequence of first turns is a node. A node's key is a 128-bit polynomial of its turns' digests, so equal prefixes meet by
key without moving texts. Distinct conversations are ranked in the lexicographic order of their keys; a node is the interval of ranks that
start with it, nodes sorted by (first rank, depth) stand in preorder, and a node's subtree ends where the nodes that begin at its last
rank end. Leaves and savings of a subtree are differences of running sums at those two places.

Turns are ordered by turn (null first), then by their digest. Null role or text counts as empty; equal turns at equal places are one node,
repeated rows are turns of their own. Rows without a conversation id belong to no conversation and are left out. An empty table
has no node, not even the root. Texts of any length are only digested; extra columns are not read. No step holds a whole
conversation or a node's members in one task, but for the order of ``ends``, which one task streams for each node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.running import chained, running
from brindle.llm.shared import Scratch, crc32_sql, own_columns, range_count

#: Turns of one block of a sort key. Longer conversations are ranked block by block, then by the ranks of their blocks.
BLOCK = 512
_KEY = ["key1", "key2", "depth"]


@dataclass
class Trie:
    """``nodes``: node (place in preorder), subtree_end (place of the last node below), depth, conv_id (the least member), parent, parent_conv_id,
    n_convs, n_children, n_leaves, saved, key1, key2. ``members``: conv_id and the node where it ends, by key1, key2, depth."""

    nodes: DataFrame
    members: DataFrame


def digests(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, label (16 bytes that stand for role and text) and chars (code points of the text)."""
    rows = own_columns(conversations, key, turn, role, text).toDF("conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    label = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    return rows.select("conv_id", "turn", label.alias("label"), F.char_length(text).cast("long").alias("chars"))


def grafted(scratch: Scratch, turns: DataFrame, donor: F.Column, count: F.Column, most: int, parts: int) -> DataFrame:
    """Conversations with their first ``count`` turns replaced by as many of the conversation ``donor``; both are expressions over conv_id.

    ``most`` is the greatest count; only so many turns of a donor are sent to those that take them."""
    placed = chained(scratch, turns, "conv_id", ["turn", "label"], parts).select("conv_id", "depth", "label", "chars")
    takers = placed.select("conv_id").distinct().select("conv_id", donor.alias("donor"), count.alias("h")).where("h > 0")
    heads = placed.where(F.col("depth") <= most).select(F.col("conv_id").alias("donor"), "depth", "label", "chars")
    taken = takers.join(heads, "donor").where("depth <= h").select("conv_id", F.lit(0).alias("part"), "depth", "label", "chars")
    own = placed.where(F.col("depth") > count).select("conv_id", F.lit(1).alias("part"), "depth", "label", "chars")
    return taken.unionByName(own).withColumnRenamed("depth", "turn")


def _ranked(scratch: Scratch, turns: DataFrame, distinct: DataFrame, block: int, parts: int) -> DataFrame:
    """conv_id of each distinct sequence and its place in the lexicographic order of the keys along it."""
    symbol = F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("key1", "key2")])
    rows = turns.join(distinct.select("conv_id"), "conv_id").select("conv_id", F.col("depth").alias("k"), symbol.alias("symbol"))
    longest = distinct.agg(F.max("depth")).first()[0] or 0
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "symbol"))), lambda x: x["symbol"]), "").alias("path")
    blocks = lambda rows: rows.groupBy("conv_id", F.expr(f"(k - 1) DIV {block} + 1").alias("k")).agg(path)  # noqa: E731  up to ``block`` rows a group
    found = blocks(rows)
    while longest > block:
        longest = -(-longest // block)
        found = scratch.put(found)
        names = running(scratch, found.select("path").distinct(), ["path"], parts).select("path", F.lpad(F.hex("at"), 16, "0").alias("symbol"))
        found = blocks(found.join(names, "path").select("conv_id", "k", "symbol"))
    bare = distinct.where("depth = 0").select("conv_id", F.lit("").alias("path"))
    return running(scratch, found.select("conv_id", "path").unionByName(bare), ["path"], parts).select("conv_id", F.col("at").alias("rank"))


def build(scratch: Scratch, turns: DataFrame, order: list[str], parts: int, everyone: DataFrame | None = None, block: int = BLOCK) -> Trie:
    """The trie of ``turns`` (conv_id, the columns of ``order``, label, chars); ``everyone``: all conversation ids, where some may have no turns;
    ``parts``: ranges to sort in (see ``range_count`` of the table as read)."""
    rows = chained(scratch, turns, "conv_id", order, parts).drop("label", *order)
    none = [F.lit(0).cast("long").alias(c) for c in ("depth", "key1", "key2")]
    ends = rows.select("conv_id", "depth", "key1", "key2")
    if everyone is not None:
        ends = ends.unionByName(everyone.select("conv_id", *none))
    ends = scratch.put(ends.groupBy("conv_id").agg(F.max(F.struct("depth", "key1", "key2")).alias("end")).select("conv_id", "end.*"))
    distinct = scratch.put(ends.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")))
    ranks = _ranked(scratch, rows, distinct, block, parts)
    ranked = scratch.put(distinct.join(ranks, "conv_id").select("conv_id", "n", "rank", F.col("depth").alias("length")))

    along = rows.join(ranked, "conv_id")
    top = ranked.select("*", *none, F.lit(0).cast("long").alias("up1"), F.lit(0).cast("long").alias("up2"), F.lit(0).cast("long").alias("chars"))
    size = [F.min("rank").alias("first"), F.max("rank").alias("last"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("length").alias("length")]
    nodes = along.unionByName(top).groupBy(*_KEY).agg(*size, *[F.max(c).alias(c) for c in ("chars", "up1", "up2")])
    leaf = ((F.col("first") == F.col("last")) & (F.col("depth") == F.col("length"))).cast("long")
    nodes = nodes.withColumn("leaf", leaf).withColumn("saving", (F.col("n_convs") - 1) * F.col("chars")).drop("length", "chars")
    nodes = scratch.put(running(scratch, nodes, ["first", "depth"], parts, ("leaf", "saving")))

    closing = nodes.groupBy(F.col("first").alias("last")).agg(F.max("at").alias("subtree_end"), F.max("leaf_sum").alias("leaves"), F.max("saving_sum").alias("savings"))
    below = nodes.where("depth > 0").groupBy(F.col("up1").alias("key1"), F.col("up2").alias("key2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    inner = nodes.join(below, _KEY, "left_semi").select(F.col("key1").alias("up1"), F.col("key2").alias("up2"), (F.col("depth") + 1).alias("depth"), F.col("at").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(closing, "last").join(below, _KEY, "left").join(inner, ["up1", "up2", "depth"], "left")
    return Trie(
        found.select(
            F.col("at").alias("node"), "subtree_end", "depth", "conv_id", "parent", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            (F.col("leaves") - F.col("leaf_sum") + F.col("leaf")).alias("n_leaves"), (F.col("savings") - F.col("saving_sum") + F.col("saving")).alias("saved"), "key1", "key2",
        ),
        ends,
    )


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> Trie:
    """The trie of a table of conv_id, turn, role and text."""
    scratch, turns = Scratch(conversations.sparkSession, "trie"), digests(conversations)
    return build(scratch, turns, ["turn", "label"], range_count(turns, 1), block=block)


def ends_digest(members: DataFrame) -> DataFrame:
    """SHA-256 (hex) of the ids that end at each node, ascending and joined by commas; one task streams a node's ids in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []
        for b in batches:
            for *key, conv in zip(*[b.column(c).to_pylist() for c in [*_KEY, "conv_id"]], strict=True):
                if key != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], [*_KEY, "ends_sha256"])
                done = []
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], [*_KEY, "ends_sha256"])

    rows = members.select(*_KEY, "conv_id").repartition(*_KEY).sortWithinPartitions(*_KEY, "conv_id")
    return rows.mapInArrow(run, "key1 long, key2 long, depth long, ends_sha256 string")


def oracle_sql() -> str:
    """The query's rows by paths of digests and a join of every node with all nodes above it."""
    return f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
takers AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS donor, {crc32_sql("conv_id::VARCHAR")} % 6 AS h FROM turns),
rebuilt AS (
  SELECT t.conv_id, 0 AS part, o.n, o.role, o.text FROM takers t JOIN turns o ON o.conv_id = t.donor AND o.n <= t.h
  UNION ALL SELECT t.conv_id, 1, o.n, o.role, o.text FROM takers t JOIN turns o ON o.conv_id = t.conv_id AND o.n > t.h),
placed AS (
  SELECT conv_id, length(text) AS chars, row_number() OVER w AS depth, string_agg(md5(length(role) || ':' || role || text), '') OVER w AS path
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, n)),
members AS (SELECT conv_id, depth, path, chars FROM placed UNION ALL SELECT conv_id, 0, '', 0 FROM takers),
nodes AS (SELECT path, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * min(chars) AS saving FROM members GROUP BY path),
ended AS (SELECT conv_id, max_by(path, depth) AS path FROM members GROUP BY conv_id),
ends AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM ended GROUP BY path),
kids AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
subtree AS (
  SELECT a.path, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(b.saving) AS saved_tokens
  FROM nodes b JOIN members a ON a.conv_id = b.conv_id AND a.depth <= b.depth LEFT JOIN kids k ON k.path = b.path GROUP BY a.path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM nodes n JOIN subtree s ON s.path = n.path LEFT JOIN kids k ON k.path = n.path LEFT JOIN ends e ON e.path = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 32)"""
