"""All registered queries."""

from brindle.plans import chunking, evaluation, lifecycle, relations, retrieval, roundtrips, scalars, searches, streams, telemetry  # noqa: F401
from brindle.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
