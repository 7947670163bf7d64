"""Path and name normalisation that needs Unicode composition: Arrow-batched, for small listings of files."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESERVED = {"con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))}


def safe_path(path: str) -> str:
    """NFC; characters no file system takes become _, names lose blanks and dots at the end, reserved names a _ in front."""

    def one(part: str) -> str:
        part = re.sub(r'[<>:"|?*\x00-\x1f\\]', "_", part).rstrip(" .") or "_"
        return f"_{part}" if part.split(".")[0].lower() in RESERVED else part

    return "/".join(one(p) for p in unicodedata.normalize("NFC", path).split("/"))


@F.pandas_udf(T.StringType())
def safe_paths(paths: pd.Series) -> pd.Series:
    return paths.map(lambda p: None if p is None else safe_path(p))


def distinct_paths(files: DataFrame, path: str = "path", source: str = "source_path") -> DataFrame:
    """Safe paths; where several differ in case only, each gets a hash of its source before the suffix. ``collides`` tells how many share one."""
    rows = files.withColumn("safe", safe_paths(F.col(path)))
    same = Window.partitionBy(F.lower("safe"))
    rows = rows.withColumn("collides", F.count("*").over(same))
    stem, suffix = F.regexp_extract("safe", r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract("safe", r"^(.*?)(\.[^./]*)?$", 2)
    return rows.withColumn("target", F.when(F.col("collides") > 1, F.concat(stem, F.lit("--"), F.substring(F.sha2(F.col(source), 256), 1, 8), suffix)).otherwise(F.col("safe"))).drop("safe")


def tool_name(server: Column, tool: Column, most: int = 64) -> Column:
    """A remote tool's local name: letters, digits, _ and -, cut to length."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.concat_ws("_", F.lit("mcp"), server, tool), r"[^A-Za-z0-9_-]+", "_"), "^_+|_+$", ""), 1, most)


def distinct_tool_names(tools: DataFrame, order: str, server: str = "server", tool: str = "tool", most: int = 64) -> DataFrame:
    """The first tool of a name keeps it; later ones end in a hash."""
    named = tools.withColumn("name", tool_name(F.col(server), F.col(tool), most))
    n = F.row_number().over(Window.partitionBy("name").orderBy(order))
    mark = F.substring(F.sha2(F.concat_ws(":", server, tool), 256), 1, 8)
    return named.withColumn("name", F.when(n > 1, F.concat(F.substring("name", 1, most - 9), F.lit("_"), mark)).otherwise(F.col("name")))


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
