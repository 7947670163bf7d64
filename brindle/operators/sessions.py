"""Writes on sessions, turns, summaries, job descriptions and journals: each a function from tables to new tables, stored by one ``Store`` switch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.operators import relational


def new_session(requests: DataFrame, now: Column, first_id: int, default_title: str = "新会话") -> DataFrame:
    """Session rows of requests (order, user_id, persona_id, subject, title): stripped title or the default, one time for both stamps."""
    title = X.strip(F.coalesce("title", F.lit("")))
    return relational.numbered(requests, ["order"], first_id, "id").select("id", "user_id", F.when(title == "", default_title).otherwise(title).alias("title"), "persona_id", "subject", now.alias("created_at"), now.alias("updated_at"))


def touch(sessions: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Sessions named in keys (id) get ``updated_at``."""
    mark = keys.select("id").distinct().withColumn("__t", F.lit(True))
    return sessions.join(mark, "id", "left").withColumn("updated_at", F.when(F.col("__t"), now).otherwise(F.col("updated_at"))).select(*sessions.columns)


def retitle(sessions: DataFrame, titles: DataFrame) -> DataFrame:
    """New titles (id, title), cut like a first message; ``updated_at`` stays, so the order of recency does too."""
    return relational.patch(sessions, titles.select("id", X.title(F.col("title")).alias("title")), "id")


def save_turns(conversations: DataFrame, sessions: DataFrame, turns: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations with the new turns (id, session_id, user_id, message, reply_json), and their sessions touched; turns whose session is
    missing or another user's are left out."""
    ok = turns.join(sessions.select(F.col("id").alias("session_id"), F.col("user_id").alias("__owner")), "session_id").where("__owner = user_id").drop("__owner")
    new = ok.withColumn("created_at", now)
    return conversations.unionByName(new, allowMissingColumns=True), touch(sessions, ok.select(F.col("session_id").alias("id")), now)


def save_summaries(summaries: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """One summary a session: replaced by new ones (session_id, summary_text, last_conversation_id), the first creation time kept."""
    rows = new.withColumn("created_at", now).withColumn("updated_at", now)
    return relational.upsert(summaries, rows, "session_id", keep=["created_at"])


def job_rows(rows: DataFrame, lists: list[str]) -> DataFrame:
    """List columns cleaned and stored as JSON text in ``<name>_json``."""
    return rows.select(*[c for c in rows.columns if c not in lists], *[F.to_json(X.clean_list(F.col(c))).alias(f"{c}_json") for c in lists])


def add_entries(journal: DataFrame, entries: DataFrame, now: Column, today: Column) -> DataFrame:
    """Journal entries; the date is the local day where none is given, never taken from the UTC stamp."""
    new = entries.withColumn("entry_date", F.coalesce("entry_date", today)).withColumn("created_at", now).withColumn("updated_at", now)
    return journal.unionByName(new, allowMissingColumns=True)


def change_entries(journal: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Only the given values change; a change without any leaves the row and its stamp as they are."""
    fields = [c for c in changes.columns if c != "id"]
    some = changes.where(" OR ".join(f"{c} IS NOT NULL" for c in fields)) if fields else changes.limit(0)
    return relational.patch(journal, some.withColumn("updated_at", now), "id")


def delete_entries(journal: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The journal without the ids, and for each id whether it ``existed``."""
    known = journal.select("id").distinct().withColumn("existed", F.lit(True))
    return relational.delete(journal, ids, "id"), ids.select("id").distinct().join(known, "id", "left").withColumn("existed", F.coalesce("existed", F.lit(False)))
