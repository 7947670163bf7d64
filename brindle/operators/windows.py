"""Order-dependent computations of sessions, traces and evidence as window expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECENT, TRIGGER = 6, 8
RING = 2000
WEB_CALLS, FAILURES = 2, 2


def recent_turns(turns: DataFrame, session: str, order: str, n: int = RECENT) -> DataFrame:
    """The last n turns of each session, oldest first by ``place``."""
    last = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    rows = turns.withColumn("__n", last).where(F.col("__n") <= n).drop("__n")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy(order)))


def summary_due(turns: DataFrame, session: str, order: str, recent: int = RECENT, trigger: int = TRIGGER) -> DataFrame:
    """Sessions whose turns beyond the recent ones number ``trigger`` or more: how many are to be summarised, and the last of them (the watermark)."""
    whole = Window.partitionBy(session)
    rows = turns.withColumn("__all", F.count("*").over(whole)).withColumn("__n", F.row_number().over(whole.orderBy(order)))
    rows = rows.where((F.col("__all") - recent >= trigger) & (F.col("__n") <= F.col("__all") - recent))
    return rows.groupBy(session).agg(F.count("*").alias("to_summarise"), F.max(order).alias("watermark"))


def evidence_ids(rows: DataFrame, run: str, kind: str, fingerprint: str, order: str) -> DataFrame:
    """Ids such as note_1, numbered within a run and kind by first appearance; one fingerprint keeps one id."""
    first = F.min(order).over(Window.partitionBy(run, kind, fingerprint))
    rows = rows.withColumn("__first", first)
    n = F.dense_rank().over(Window.partitionBy(run, kind).orderBy("__first"))
    return rows.withColumn("evidence_id", F.concat_ws("_", kind, n.cast("string"))).drop("__first")


def first_seen(rows: DataFrame, by: str, order: str) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where("__n = 1").drop("__n")


def last_rows(rows: DataFrame, *order: str, n: int = RING) -> DataFrame:
    """The newest n rows; a bounded top-n, not a window over everything."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)


def within_budget(calls: DataFrame, trace: str, tool: str, order: str, most: int = WEB_CALLS) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(trace, tool).orderBy(order))
    return calls.withColumn("call", n).withColumn("allowed", n <= most)


def cut_off(calls: DataFrame, trace: str, order: str, failed: Column, most: int = FAILURES) -> DataFrame:
    """Calls up to the one by which a trace has failed ``most`` times, that one included, with the failures so far."""
    w = Window.partitionBy(trace).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = calls.withColumn("failures", F.sum(failed.cast("int")).over(w))
    return rows.where(F.col("failures") - failed.cast("int") < most)


def cut_off_rounds(calls: DataFrame, trace: str, turn: str, failed: Column, most: int = FAILURES) -> DataFrame:
    """Calls of the rounds up to that in which a trace's failures reach ``most``, whole rounds only, so the last may overshoot; ``turn`` is an integer.
    ``failures`` counts to the end of the round."""
    w = Window.partitionBy(trace).orderBy(turn)
    bad = F.coalesce(failed, F.lit(False)).cast("int")
    rows = calls.withColumn("failures", F.sum(bad).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    before = F.coalesce(F.sum(bad).over(w.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__before", before).where(F.col("__before") < most).drop("__before")


def not_contiguous(rows: DataFrame, group: str, number: str, start: int = 0) -> DataFrame:
    """Groups whose numbers are not start, start + 1, ... without gap or repeat."""
    found = rows.groupBy(group).agg(F.min(number).alias("least"), F.max(number).alias("most"), F.count("*").alias("n"), F.countDistinct(number).alias("kinds"))
    return found.where((F.col("least") != start) | (F.col("most") - F.col("least") + 1 != F.col("n")) | (F.col("kinds") != F.col("n")))


def moved(before: DataFrame, after: DataFrame, query: str, key: str) -> DataFrame:
    """Rank of each hit before and after reranking."""
    a, b = before.select(query, key, F.col("rank").alias("before")), after.select(query, key, F.col("rank").alias("after"))
    return a.join(b, [query, key], "full_outer")


def least_id(rows: DataFrame, *group: str, key: str = "id") -> DataFrame:
    return rows.groupBy(*group).agg(F.min(key).alias(key))


def budgeted(blocks: DataFrame, group: str, order: str, text: str, budget: int, *, separator: int = 2, mark: str = "...", least: int = 80) -> DataFrame:
    """Blocks of each group in order while their lengths, with separators between, fit the budget; the first that does not is cut to the rest if more
    than ``least`` characters are left (``mark`` included), and ends the group."""
    w = Window.partitionBy(group).orderBy(order)
    gap = F.when(F.row_number().over(w) > 1, separator).otherwise(0)
    rows = blocks.withColumn("__gap", gap).withColumn("__size", F.length(text) + F.col("__gap")).withColumn("__upto", F.sum("__size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fits, starts = F.col("__upto") <= budget, (F.col("__upto") - F.col("__size")) <= budget
    left = F.lit(budget) - (F.col("__upto") - F.col("__size")) - F.col("__gap")
    rows = rows.withColumn("__before", F.coalesce(F.max((~fits).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.where((F.col("__before") == 0) & starts & (fits | (left > least)))
    cut = F.concat(F.expr(f"substring({text}, 1, {budget} - (__upto - __size) - __gap - {len(mark)})"), F.lit(mark))
    return rows.withColumn("used", F.when(fits, F.col(text)).otherwise(cut)).withColumn("truncated", ~fits).drop("__gap", "__size", "__upto", "__before")


def framed(blocks: DataFrame, group: str, order: str, text: str, frame: Column, budget: int, *, header: int = 0, mark: str = "…") -> DataFrame:
    """Blocks of each group in order while header, frames (``frame`` characters around each text) and texts fit the budget. The first text that does not is
    cut to the room left, white space at its end removed and ``mark`` within the room, and ends the group; so does a block without room for any text."""
    w = Window.partitionBy(group).orderBy(order)
    n = F.length(F.coalesce(text, F.lit("")))
    upto = F.sum(n + frame).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = blocks.withColumn("__room", F.lit(budget - header) - (upto - n)).withColumn("truncated", n > F.col("__room"))
    stop = (F.col("truncated") | (F.col("__room") <= 0)).cast("int")
    rows = rows.withColumn("__stopped", F.coalesce(F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("__stopped = 0 AND __room > 0")
    short = F.regexp_replace(F.substring(F.col(text), F.lit(1), F.greatest(F.col("__room") - len(mark), F.lit(0)).cast("int")), r"\s+$", "")
    return rows.withColumn("used", F.when(F.col("truncated"), F.concat(short, F.lit(mark))).otherwise(F.coalesce(text, F.lit("")))).drop("__room", "__stopped")


def hard_cut(sections: DataFrame, group: str, text: str, head: Callable[[Column], Column], budget: int, *, newest: str, key: str) -> DataFrame:
    """group, n, context: a head (of the number of sections) and all sections, newest first, parted by an empty line; cut as a whole to ``budget``
    characters without white space at the end. Only sections that begin within the budget are gathered; null where no section has any text."""
    w = Window.partitionBy(group).orderBy(F.desc(newest), F.desc(key))
    rows = sections.select(group, F.coalesce(text, F.lit("")).alias("t"), F.row_number().over(w).alias("i"), F.sum(F.length(F.coalesce(text, F.lit(""))) + 2).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    near = F.when(F.col("upto") - F.length("t") - 2 < budget, F.struct("i", "t"))  # collect_list leaves nulls out
    out = rows.groupBy(group).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(near)).alias("s"), (F.max("upto") - 2).alias("size"), F.bool_and(~F.rlike("t", F.lit(r"\S"))).alias("blank"))
    full = F.concat(head(F.col("n")), F.array_join(F.transform("s", lambda x: x["t"]), "\n\n"))
    cut = F.regexp_replace(F.substring(full, 1, budget), r"\s+$", "")
    return out.select(group, "n", F.when(F.col("blank"), None).when(F.length(head(F.col("n"))) + F.col("size") > budget, cut).otherwise(full).alias("context"))
