"""Subject shards: consistency before they are searched, the identity of an existing index, the choice of an index for a query, installs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import manifest

# Fixed value: what shard collections are called.
PREFIX = "learning_notes_"


def problems(shards: DataFrame) -> DataFrame:
    """Shards (collection, space, manifest_collection, embedding_model; nulls where there is no manifest) that break a rule: cosine space, a manifest of
    their own name, a valid slug, one embedding model for all."""
    slug = F.rlike("collection", F.lit(f"^{PREFIX}[A-Za-z0-9][A-Za-z0-9_-]{{1,61}}[A-Za-z0-9]$"))
    models = shards.agg(F.countDistinct("embedding_model").alias("models"))
    problem = F.when(~slug, "slug").when(F.coalesce("space", F.lit("")) != "cosine", "space").when(F.col("manifest_collection").isNotNull() & (F.col("manifest_collection") != F.col("collection")), "manifest").when((F.col("models") > 1) & F.col("embedding_model").isNotNull(), "embedding_model")
    return shards.crossJoin(F.broadcast(models)).select("collection", problem.alias("problem")).where("problem IS NOT NULL")


def identity_problem(record: dict | None, count: int, collection: str, model: str, vector: Sequence[float]) -> str | None:
    """Why a stored index must not be searched with this model and query vector, or None."""
    if record is None:
        return "no_manifest"
    for name, found, wanted in (("count", count, record.get("chunks")), ("collection", record.get("collection"), collection), ("embedding_model", record.get("embedding_model"), model), ("dimension", len(vector), record.get("dimension"))):
        if found != wanted:
            return name
    return None


def route(subject: str | None, known: Sequence[str]) -> list[str]:
    """One shard for a known subject, all for none or an unknown one."""
    return [subject] if subject in known else list(known)


def freeze(entries: DataFrame, root: str, subject: str) -> dict[str, int]:
    """One shard a subject, all in one write of Parquet folders; the entries of each, which the commit record names last.

    Rebalancing puts small subjects together and parts a large one over several tasks. Entries without a subject are an error."""
    if not entries.where(F.col(subject).isNull()).isEmpty():
        raise ValueError("entries without a subject")
    manifest.invalidate(entries.sparkSession, f"{root}/frozen.json")
    entries.hint("rebalance", subject).write.mode("overwrite").partitionBy(subject).parquet(f"{root}/shards")
    schema = ", ".join(f"`{c}` {t}" for c, t in entries.dtypes)
    stored = entries.sparkSession.read.schema(schema).parquet(f"{root}/shards")
    counts = {str(r[0]): r["count"] for r in stored.groupBy(subject).count().collect()}  # a number a shard
    manifest.write_commit(entries.sparkSession, f"{root}/frozen.json", {"schema": schema, "subject": subject, "entries": counts})
    return counts


def frozen(spark: SparkSession, root: str, subjects: Sequence[str]) -> DataFrame:
    """The entries of some frozen shards; folders of others are not opened."""
    record = manifest.read_commit(spark, f"{root}/frozen.json")
    if record is None:
        raise ValueError(f"no frozen shards at {root}")
    return spark.read.schema(record["schema"]).parquet(f"{root}/shards").where(F.col(record["subject"]).isin(list(subjects)))


def index_for(record: dict | None, use_hybrid: bool, sharded: bool) -> str:
    """Which search answers a query: the shard router, hybrid if the index has a valid manifest, else vectors alone."""
    if sharded:
        return "shards"
    return "hybrid" if use_hybrid and record is not None else "vector"


def manifests(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest files (path, text): those that parse, and those that do not with the reason."""
    parsed = F.from_json("text", "schema_version int, fingerprint string, chunks bigint, settings map<string,string>")
    rows = files.withColumn("m", parsed).withColumn("problem", F.when(F.try_parse_json("text").isNull(), "not_json").when(F.coalesce(F.col("m.schema_version"), F.lit(0)) != 1, "schema_version").when(F.col("m.fingerprint").isNull(), "fingerprint"))
    return rows.where("problem IS NULL").select("path", "m.*").orderBy("path"), rows.where("problem IS NOT NULL").select("path", "problem")


def install(spark: SparkSession, staged: str, target: str, expect: int) -> None:
    """Replace a folder by a staged one of ``expect`` files: verified first, the old one kept aside until the new one stands, and put back if that fails."""
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.getContentSummary(path(staged)).getFileCount()
    if found != expect:
        raise ValueError(f"{found} files staged where {expect} were expected")
    aside = f"{target}.old"
    fs.delete(path(aside), True)
    had = fs.exists(path(target))
    if had and not fs.rename(path(target), path(aside)):
        raise OSError(f"cannot move {target} aside")
    if not fs.rename(path(staged), path(target)):
        if had:
            fs.rename(path(aside), path(target))
        raise OSError(f"cannot install {target}")
    fs.delete(path(aside), True)
