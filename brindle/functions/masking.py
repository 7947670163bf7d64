"""Masking of credentials in JSON of any depth: recursive, so Arrow-batched Python; flat text is masked by ``text.masked_values``."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.text import SECRET_KEYS

MASK = "[REDACTED]"
_KEY = re.compile(SECRET_KEYS, re.IGNORECASE)
_PLAIN = re.compile(rf"([\"']?[^\s\"']*(?:{SECRET_KEYS.replace('_', '[_-]?')})[^\s\"']*[\"']?\s*[:=]\s*)(\"[^\"]*\"|'[^']*'|[^,}}\s]+)", re.IGNORECASE)


def masked(value):
    """A JSON value with whatever stands under a credential's name masked."""
    if isinstance(value, dict):
        return {k: MASK if _KEY.search(k) else masked(v) for k, v in value.items()}
    return [masked(v) for v in value] if isinstance(value, list) else value


def preview_of(text: str | None, most: int) -> str | None:
    if text is None:
        return None
    try:
        shown = json.dumps(masked(json.loads(text)), ensure_ascii=False)
    except ValueError:
        shown = _PLAIN.sub(rf"\1{MASK}", text)
    return shown[:most]


def args_preview(text: Column, most: int = 500) -> Column:
    """Masked JSON, or masked plain text where it is no JSON, cut to length."""

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: preview_of(v, most))

    return run(text)


def captured(text: Column, capture: bool, most: int = 4000) -> Column:
    """What a trace keeps of a message: nothing unless capture is on, then a bounded part."""
    return F.substring(text, 1, most) if capture else F.lit(None).cast("string")
