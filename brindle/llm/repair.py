"""Repair of conversation structure at the least cost.

A conversation's turns should read ``(s?(ua)+)?`` by the first letters of their roles. Edits: Keep (0), Rerole to user or assistant (2), Delete (3;
blank and duplicate turns must go), Insert an empty user or assistant turn (2); a truncated turn that stays adds 1. The edits are the cheapest
path through the lattice of (turn index, grammar state), found by Dijkstra's algorithm under the key (cost, audit): audit is the edits' initials in
order, compared as text, so ties fall the same way everywhere. The lattice is never built: a node's edges follow from its turn. Audits are
shared paths with jump pointers, compared in logarithmic time, so a conversation of n turns takes n log n steps and no quadratic space.

Turns lie in order of turn (null first), then of role and digest; equal turns in both are the same. Null role or text counts as one space. A null conversation id
is a conversation of its own. A conversation without turns has zeros, an empty audit and nothing repaired. Blank: no character but ASCII
blanks; duplicate: role and text seen earlier; truncated: the last other character is none of ``.!?``; the first that holds counts. Texts of any length are
only digested before the search, and streamed in order after it. The audit of a conversation and the digest of its texts are each one value in
order, so a conversation is searched by one task: about 30 bytes a turn and up to 1 KB while its lattice is open. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from brindle.llm.shared import crc32_sql, own_columns

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Grammar states: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn. 0 and 3 may end.
_NEXT = (2, 2, 3, 2)
_KEPT = ({1: 1, 2: 2}, {2: 2}, {3: 3}, {2: 2})
_INITIAL = {"s": 1, "u": 2, "a": 3}
_ROLE = {2: "user", 3: "assistant"}
_LEGAL = {(1, 2), (2, 3), (3, 2)}
_BLANK = " \t\n\x0b\f\r"
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


class Audit:
    """A sequence of letters as a path to the root, with a second pointer far up it (skew-binary), ordered as text.

    Two paths in one search have the same letters only where they are the same object, since a letter leads from a node to one node."""

    __slots__ = ("letter", "up", "jump", "size")

    def __init__(self, letter: str = "", up: Audit | None = None):
        self.letter, self.up = letter, up or self
        self.size = up.size + 1 if up else 0
        far = up and up.jump
        self.jump = self if not up else far.jump if up.size - far.size == far.size - far.jump.size else up

    def start(self, size: int) -> Audit:
        """The first ``size`` letters."""
        at = self
        while at.size > size:
            at = at.jump if at.jump.size >= size else at.up
        return at

    def __lt__(self, other: Audit) -> bool:
        size = min(self.size, other.size)
        a, b = self.start(size), other.start(size)
        if a is b:
            return self.size < other.size
        while a.up is not b.up:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.up, b.up)
        return a.letter < b.letter

    def __str__(self) -> str:
        letters, at = [], self
        while at.size:
            letters.append(at.letter)
            at = at.up
        return "".join(reversed(letters))


def cheapest(initials: list[int], gone: list[bool], cut: list[bool]) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of turns with these initials (1 s, 2 u, 3 a, 0 other); ``gone``: must be deleted."""
    n = len(initials)
    best, settled = {0: 0}, bytearray(4 * n + 4)
    heap = [(0, Audit(), 0)]
    while heap:
        cost, audit, node = heapq.heappop(heap)
        if settled[node]:
            continue
        settled[node] = 1
        best.pop(node, None)
        i, state = divmod(node, 4)
        if i == n and state in (0, 3):
            return cost, str(audit)
        edges = [(INSERT, "I", 4 * i + _NEXT[state])]
        if i < n:
            edges.append((DELETE, "D", node + 4))
            if not gone[i]:
                edges.append((REROLE + CUT * cut[i], "R", 4 * i + 4 + _NEXT[state]))
                if kept := _KEPT[state].get(initials[i]):
                    edges.append((KEEP + CUT * cut[i], "K", 4 * i + 4 + kept))
        for step, letter, to in edges:
            if not settled[to] and cost + step <= best.get(to, cost + step):
                best[to] = cost + step
                heapq.heappush(heap, (cost + step, Audit(letter, audit), to))
    raise AssertionError("deleting every turn is a repair")


def _examined(parts: list[pa.RecordBatch]) -> tuple:
    """The report of one conversation from its turns' marks, in order."""
    rows = pa.Table.from_batches(parts)
    rows = rows.filter(rows["present"])
    n = rows.num_rows
    turns = rows["turn"].drop_null().to_numpy()
    gaps = int(turns.max()) - int(turns.min()) + 1 - len(np.unique(turns)) if len(turns) else 0
    blank, cut = rows["blank"].to_numpy(), rows["cut"].to_numpy()
    seen: set[bytes] = set()
    repeated = np.zeros(n, bool)
    for i, digest in enumerate(rows["digest"].to_pylist()):
        repeated[i] = digest in seen
        seen.add(digest)
    duplicate = repeated & ~blank
    truncated = cut & ~blank & ~duplicate
    initials = [_INITIAL.get(x, 0) for x in rows["initial"].to_pylist()]
    illegal = sum(pair not in _LEGAL for pair in zip(initials, initials[1:], strict=False))
    cost, audit = cheapest(initials, (blank | duplicate).tolist(), truncated.tolist())
    return gaps, int(blank.sum()), int(duplicate.sum()), int(truncated.sum()), illegal, cost, audit


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Slices of equal values of a sorted column, and whether a slice begins a new value."""
    last, begun = None, False
    for b in batches:
        ids, lo = b.column(column).to_pylist(), 0
        for hi in [*[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)] if ids else []:
            yield not begun or ids[lo] != last, b.slice(lo, hi - lo)
            last, begun, lo = ids[lo], True, hi


_ORDER = ["turn", "role", "digest"]


def marked(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text; ``present``: false for a row that only names its conversation) with what the search needs of them."""
    rows = turns if "present" in turns.columns else own_columns(turns, "conv_id", "turn", "role", "text").withColumn("present", F.lit(True))
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), "present")
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    core = F.rtrim("text", F.lit(_BLANK))
    return rows.withColumns({"digest": digest, "initial": F.substring("role", 1, 1), "blank": core == "", "cut": ~F.substring(core, -1, 1).isin(".", "!", "?")})


def examine(turns: DataFrame) -> DataFrame:
    """A report for each conversation: the counts of its faults, the least cost of a repair and its audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []

        def report() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([parts[0].column("conv_id").slice(0, 1), *[pa.array([x]) for x in _examined(parts)]], ["conv_id", *_COUNTS])

        for new, part in _runs(batches, "conv_id"):
            if new and parts:
                yield report()
                parts = []
            parts.append(part)
        if parts:
            yield report()

    rows = marked(turns).drop("text").repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER)
    return rows.mapInArrow(run, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {REPORT}")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each conversation its report row, then (edit, role, text) of every repaired turn, in order."""
    audit, at, state = "", 0, 0
    for b in batches:
        rows = zip(*[b.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "initial", *_COUNTS)], strict=True)
        for conv, kind, role, text, initial, *report in rows:
            if kind == 0:
                audit, at, state = report[-1], 0, 0
                yield "report", conv, report
            else:
                edit = audit[at]
                at += 1
                if edit != "D":
                    state = _KEPT[state][_INITIAL[initial]] if edit == "K" else _NEXT[state]
                    yield "turn", edit, role if edit == "K" else _ROLE[state], text
            while audit[at : at + 1] == "I":  # inserts stand behind the report or the turn before them
                at, state = at + 1, _NEXT[state]
                yield "turn", "I", _ROLE[state], ""


def _with_reports(turns: DataFrame, reports: DataFrame) -> DataFrame:
    """Each conversation's report, then its turns in order, in one task."""
    rows = marked(turns).where("present").select("conv_id", F.lit(1).alias("kind"), *_ORDER, "text", "initial")
    both = reports.withColumn("kind", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER)


def repaired(turns: DataFrame, reports: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), edit (K, R or I), role, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place, rows, held = None, 0, [], 0
        for kind, *rest in _walk(batches):
            if kind == "report":
                conv, place = rest[0], 0
                continue
            rows.append((conv, place, *rest))
            place, held = place + 1, held + len(rest[2])
            if held > 1 << 22 or len(rows) == 10_000:
                yield _batch(rows, schema)
                rows, held = [], 0
        if rows:
            yield _batch(rows, schema)

    schema = T.StructType([turns.schema["conv_id"], *[T.StructField(c, k) for c, k in (("place", T.LongType()), ("edit", T.StringType()), ("role", T.StringType()), ("text", T.StringType()))]])
    return _with_reports(turns, reports).mapInArrow(run, schema)


def digested(turns: DataFrame, reports: DataFrame) -> DataFrame:
    """The reports with repaired_sha256: of the repaired turns as ``role:text``, joined by line feeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, state, first = [], None, True
        for kind, *rest in _walk(batches):
            if kind == "report":
                if rows:
                    rows[-1][-1] = rows[-1][-1].hexdigest()
                if len(rows) == 10_000:
                    yield _batch(rows, schema)
                    rows = []
                state, first = hashlib.sha256(), True
                rows.append([rest[0], *rest[1], state])
            else:
                state.update(f"{'' if first else chr(10)}{rest[1]}:".encode())
                state.update(rest[2].encode())
                first = False
        if rows:
            rows[-1][-1] = rows[-1][-1].hexdigest()
            yield _batch(rows, schema)

    schema = T.StructType([*reports.schema, T.StructField("repaired_sha256", T.StringType())])
    return _with_reports(turns, reports).mapInArrow(run, schema)


def _batch(rows: list, schema: T.StructType) -> pa.RecordBatch:
    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(x), kind.type) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], kinds.names)


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns damaged by a checksum of ``conv_id:turn`` (nulls: one space): of 20 remainders 0 drops a turn (``present`` is false), 1 empties its
    text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user."""
    rows = own_columns(conversations, "conv_id", "turn", "role", "text")
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(word("text"), ".!?", "")).otherwise(word("text"))
    copies = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(word("role")).alias("role"), text.alias("text"), (fault != 0).alias("present"), copies).drop("copy")


def oracle_sql() -> str:
    """The query's rows by a recursion over the turns that keeps the least (cost, audit, text) of each grammar state."""
    crc = crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    initial = "CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END"
    core = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    line = "chr(10) ||"
    return f"""
WITH RECURSIVE hashed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS f FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, (VALUES (0), (1)) c(copy) WHERE f <> 0 AND (copy = 0 OR f = 3)),
placed AS (
  SELECT *, {initial} AS k, {core} = '' AS blank, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    right({core}, 1) NOT IN ('.', '!', '?') AS open_end FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, lag(k) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM placed),
turns AS (SELECT *, again AND NOT blank AS dup, open_end AND NOT blank AND NOT again AS cut, blank OR again AS gone FROM seen),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
    count(*) FILTER (cut) AS truncated, count(*) FILTER (n > 1 AND (before, k) NOT IN ((1, 2), (2, 3), (3, 2))) AS illegal, count(*) AS size FROM turns GROUP BY conv_id),
inserts(q, r, paid, letters, lines) AS (
  VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
    (0, 2, 2, 'I', {line} 'user:'), (1, 2, 2, 'I', {line} 'user:'), (2, 3, 2, 'I', {line} 'assistant:'), (3, 2, 2, 'I', {line} 'user:'),
    (0, 3, 4, 'II', {line} 'user:' || {line} 'assistant:'), (1, 3, 4, 'II', {line} 'user:' || {line} 'assistant:')),
kept(q, k, r) AS (VALUES (0, 1, 1), (0, 2, 2), (1, 2, 2), (2, 3, 3), (3, 2, 2)),
walk AS (
  SELECT conv_id, 0::BIGINT AS n, 0 AS q, {{'cost': 0, 'audit': '', 'lines': ''}} AS best FROM counts
  UNION ALL
  SELECT conv_id, n, q, min({{'cost': cost, 'audit': audit, 'lines': lines}}) FROM (
    SELECT t.conv_id, t.n, e.q, w.best.cost + i.paid + e.paid AS cost, w.best.audit || i.letters || e.letter AS audit, w.best.lines || i.lines || e.line AS lines
    FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.n + 1 JOIN inserts i ON i.q = w.q,
    LATERAL (
      SELECT k.r AS q, CASE WHEN t.cut THEN 1 ELSE 0 END AS paid, 'K' AS letter, {line} t.role || ':' || t.text AS line FROM kept k WHERE k.q = i.r AND k.k = t.k AND NOT t.gone
      UNION ALL SELECT CASE i.r WHEN 2 THEN 3 ELSE 2 END, CASE WHEN t.cut THEN 3 ELSE 2 END, 'R', {line} CASE i.r WHEN 2 THEN 'assistant:' ELSE 'user:' END || t.text WHERE NOT t.gone
      UNION ALL SELECT i.r, 3, 'D', '') e) GROUP BY conv_id, n, q),
ended AS (
  SELECT c.conv_id, min({{'cost': w.best.cost + i.paid, 'audit': w.best.audit || i.letters, 'lines': w.best.lines || i.lines}}) AS best
  FROM counts c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.n = c.size JOIN inserts i ON i.q = w.q AND i.r IN (0, 3) GROUP BY c.conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, coalesce(e.best.cost, 0)::BIGINT AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(e.best.lines[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""
