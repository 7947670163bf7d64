"""Filters, joins, set operations, ordering and row-level lifecycle rules on business tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.spread import dealt

# Document states.
RECOVERABLE = ["UPLOADED", "PARSING", "INDEXING"]
RETRIEVABLE = ["READY", "PARTIAL"]
ACTIVE = [*RECOVERABLE, *RETRIEVABLE, "FAILED"]
TRANSITIONS = {
    "UPLOADED": ["PARSING", "FAILED", "DELETING"],
    "PARSING": ["INDEXING", "FAILED", "DELETING"],
    "INDEXING": ["READY", "PARTIAL", "FAILED", "DELETING"],
    "READY": ["FAILED", "DELETING"],
    "PARTIAL": ["FAILED", "DELETING"],
    "FAILED": ["PARSING", "DELETING"],
    "DELETING": ["DELETED"],
    "DELETED": [],
}


def all_of(conditions: Sequence[Column]) -> Column:
    """Conjunction; true of no conditions."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def facets(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Equality on each facet that is given and not blank; the predicates reach the scan."""
    given = {k: v.strip() for k, v in wanted.items() if v and v.strip()}
    return rows.where(all_of([F.col(k) == v for k, v in given.items()])) if given else rows


def check_range(floor: float | None, ceiling: float | None) -> None:
    if floor is not None and floor < 0 or ceiling is not None and ceiling < 0:
        raise ValueError("a bound must not be negative")
    if floor is not None and ceiling is not None and floor > ceiling:
        raise ValueError("the lower bound exceeds the upper bound")


def contained(rows: DataFrame, low: str, high: str, floor: float | None = None, ceiling: float | None = None) -> DataFrame:
    """Rows whose interval [low, high] lies within the bounds given."""
    check_range(floor, ceiling)
    return rows.where(all_of([*([F.col(low) >= floor] if floor is not None else []), *([F.col(high) <= ceiling] if ceiling is not None else [])]))


def members(rows: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    return rows.where(F.col(column).isin(list(dict.fromkeys(allowed))))


def tag_substring(tags: Column, tag: str) -> Column:
    """The tag anywhere in the text, in any case: so a tag is also found inside a longer one. % and _ in it stay wild."""
    return F.ilike(tags, F.lit(f"%{tag}%"))


def tag_exact(tags: Column, tag: str) -> Column:
    return F.array_contains(F.transform(F.split(tags, ","), lambda t: F.lower(F.trim(t))), tag.strip().lower())


def visible(now: Column, user: str, session: int, states: Sequence[str] = ACTIVE, ignore_expiry: bool = False) -> Column:
    """Attachments of a user's session, unexpired, in one of the states."""
    own = (F.col("scope") == "ATTACHMENT") & (F.col("user_id") == user) & (F.col("session_id") == session) & F.col("status").isin(list(states))
    return own if ignore_expiry else own & (F.col("expires_at") > now)


def expired(rows: DataFrame, now: Column, limit: int | None = None, states: Sequence[str] = ACTIVE) -> DataFrame:
    out = rows.where(F.col("expires_at").isNotNull() & (F.col("expires_at") <= now) & F.col("status").isin(list(states))).orderBy("expires_at", "created_at", "id")
    return out if limit is None else out.limit(limit)


def stale(rows: DataFrame, cutoff: Column, states: Sequence[str]) -> DataFrame:
    return rows.where(F.col("status").isin(list(states)) & (F.col("updated_at") <= cutoff)).orderBy("updated_at", "created_at", "id")


def recoverable(rows: DataFrame, now: Column) -> DataFrame:
    return rows.where(F.col("status").isin(RECOVERABLE) & (F.col("expires_at").isNull() | (F.col("expires_at") > now))).orderBy("updated_at", "created_at", "id")


def staged_budget(stages: Sequence[DataFrame], order: Sequence[str], budget: int) -> DataFrame:
    """The first ``budget`` rows over several selections, earlier stages first, each in its order; a row counts in its first stage only. Each stage
    is cut to the budget before they meet, so at most stages x budget rows do."""
    out = None
    for i, rows in enumerate(stages):
        one = rows.orderBy(*order).limit(budget).withColumn("stage", F.lit(i))
        out = one if out is None else out.unionByName(one)
    first = out.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy("stage"))).where("__n = 1").drop("__n")
    return first.orderBy("stage", *order).limit(budget)


def eligible_evidence(hits: DataFrame, documents: Sequence[str], threshold: float = 0.45) -> DataFrame:
    ok = F.col("document_id").isin(list(documents)) & (F.length(F.trim("text")) > 0) & (F.col("page_start") > 0) & (F.col("page_end") >= F.col("page_start")) & (F.col("similarity") >= threshold)
    return hits.where(ok).orderBy(F.desc("similarity"), "document_id", "chunk_index")


def access(requested: DataFrame, documents: DataFrame, vectors: DataFrame, now: Column, user: str, session: int) -> DataFrame:
    """What each requested document_id is: ok, not_accessible, not_ready or index_missing. At most a few ids are asked for."""
    known = documents.where(visible(now, user, session)).select(F.col("id").alias("document_id"), "status")
    indexed = vectors.select("document_id").distinct().withColumn("indexed", F.lit(True))
    rows = F.broadcast(requested.select("document_id").distinct()).join(known, "document_id", "left").join(indexed, "document_id", "left")
    state = F.when(F.col("status").isNull(), "not_accessible").when(~F.col("status").isin(RETRIEVABLE), "not_ready").when(F.col("indexed").isNull(), "index_missing").otherwise("ok")
    return rows.select("document_id", state.alias("state"))


def newest(rows: DataFrame, limit: int, *by: str, where: Column | None = None) -> DataFrame:
    """Descending by all of ``by``."""
    out = rows if where is None else rows.where(where)
    return out.orderBy(*[F.desc(c) for c in by]).limit(max(0, limit))


def after(rows: DataFrame, column: str, value, limit: int) -> DataFrame:
    return rows.where(F.col(column) > value).orderBy(column).limit(max(0, limit))


def attach_problems(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Requests (user_id, session_id) with ``problem``: session_missing, not_owner or null."""
    known = sessions.select(F.col("id").alias("session_id"), F.col("user_id").alias("owner"))
    problem = F.when(F.col("owner").isNull(), "session_missing").when(F.col("owner") != F.col("user_id"), "not_owner")
    return requests.join(known, "session_id", "left").withColumn("problem", problem).drop("owner")


def numbered(rows: DataFrame, order: Sequence[str], first: int, name: str) -> DataFrame:
    """Rows numbered from ``first`` in an order whose first column is numeric. Quantiles of that column cut the rows into ranges; the ranges' counts (one number each) give
    where each begins, so no task sees more than a range."""
    key, parts = F.col(order[0]), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []))
    dealt = rows.withColumn("__range", F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < key)), F.lit(-1)) if cuts else F.lit(0))
    counts, begin, at = sorted((r["__range"], r["count"]) for r in dealt.groupBy("__range").count().collect()), [], first
    for part, n in counts:
        begin += [F.lit(part), F.lit(at)]
        at += n
    n = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1 + (F.element_at(F.create_map(*begin), F.col("__range")) if begin else F.lit(first))
    return dealt.withColumn(name, n.cast("long")).drop("__range")


def get_or_create(sessions: DataFrame, wanted: DataFrame, now: Column, first_id: int) -> DataFrame:
    """The least session id of each (user_id, persona_id) wanted; those without one get a new row, numbered from ``first_id`` in their order, whose
    subject is left out."""
    own = sessions.groupBy("user_id", "persona_id").agg(F.min("id").alias("id"))
    rows = wanted.select("user_id", "persona_id").distinct().join(own, ["user_id", "persona_id"], "left")
    new = numbered(rows.where("id IS NULL"), ["user_id", "persona_id"], first_id, "id").withColumn("created", F.lit(True))
    both = rows.where("id IS NOT NULL").withColumn("created", F.lit(False)).unionByName(new)
    return both.select(F.col("id").cast("long").alias("id"), "user_id", "persona_id", "created", F.when(F.col("created"), now).alias("created_at"))


def patch(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the non-null values of ``changes`` (key and any columns) laid over them; unknown keys are left out."""
    columns = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = rows.join(new, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def delete(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def upsert(rows: DataFrame, new: DataFrame, key: str | Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``new`` replaces rows of the same key and adds the others; columns in ``keep`` (such as created_at) stay as they were."""
    keys = [key] if isinstance(key, str) else list(key)
    if keep:
        old = rows.select(*keys, *[F.col(c).alias(f"__{c}") for c in keep])
        new = new.join(old, keys, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in keep else F.col(c) for c in new.columns])
    return rows.join(new.select(*keys), keys, "left_anti").unionByName(new)


def quota(rows: DataFrame, most: int = 5) -> DataFrame:
    """Active rows by session in order of creation: ``accepted`` while the session has room."""
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "id"))
    return rows.where(F.col("status").isin(ACTIVE)).withColumn("accepted", n <= most)


def purge(rows: DataFrame) -> DataFrame:
    """``purgeable`` only where deletion has been completed."""
    return rows.withColumn("purgeable", F.col("status") == "DELETED")


def claim(rows: DataFrame, attempts: DataFrame) -> DataFrame:
    """Compare and set: attempts (id, expected, target, attempt) on the current state; the first attempt of each id that finds its expected state wins."""
    joined = dealt(attempts, "id").join(dealt(rows.select("id", "status"), "id"), "id", "left")
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]).cast("array<string>"))])
    fits = (F.col("status") == F.col("expected")) & F.array_contains(F.element_at(allowed, F.col("expected")), F.col("target"))
    n = F.row_number().over(Window.partitionBy("id", fits).orderBy("attempt"))
    return joined.withColumn("won", F.coalesce(fits & (n == 1), F.lit(False)))


def next_action(status: Column) -> Column:
    return F.when(status == "UPLOADED", "parse").when(status == "PARSING", "wait").when(status == "INDEXING", "index").when(status.isin(RETRIEVABLE), "done").when(status == "FAILED", "retry").otherwise("none")


def retry_state(status: Column) -> Column:
    return F.when(status.isNull(), "not_found").when(status.isin("UPLOADED", "FAILED"), "claim").when(status.isin("PARSING", "INDEXING"), "in_progress").when(status.isin(RETRIEVABLE), "complete").otherwise("not_found")


def file_problem(name: Column, mime: Column, content: Column, most: int) -> Column:
    """Why an uploaded PDF is refused, or null."""
    head = F.substring(content.cast("binary"), 1, 5).cast("string")
    return F.when(~F.endswith(F.lower(name), F.lit(".pdf")), "bad_name").when(mime != "application/pdf", "bad_mime").when(F.octet_length(content) == 0, "empty").when(F.octet_length(content) > most, "too_large").when(head != "%PDF-", "bad_magic")


def transition_problems(history: DataFrame, key: str, status: str, order: Sequence[str], allowed: Mapping[str, Sequence[str]] = TRANSITIONS) -> DataFrame:
    """Steps of a status history that the transition table does not allow."""
    edges = F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]).cast("array<string>"))])
    before = F.lag(status).over(Window.partitionBy(key).orderBy(*order))
    rows = history.withColumn("before", before)
    return rows.where(F.col("before").isNotNull() & ~F.coalesce(F.array_contains(F.element_at(edges, F.col("before")), F.col(status)), F.lit(False)))


def unsummarised(conversations: DataFrame, summaries: DataFrame) -> DataFrame:
    """Turns after each session's watermark."""
    marks = summaries.select("session_id", "last_conversation_id")
    rows = conversations.join(marks, "session_id", "left")
    return rows.where(F.col("id") > F.coalesce("last_conversation_id", F.lit(0)))


def first_seen(items: Column) -> Column:
    return F.array_distinct(items)


def set_operations(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Each key of either side with ``side``: both, removed or added."""
    a, b = old.select(key).distinct().withColumn("o", F.lit(1)), new.select(key).distinct().withColumn("n", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.select(key, F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("both").alias("side"))
