"""Named queries: operators put together over the given tables."""

from deflow.plans import flow, language, payloads, programs, records, stores  # noqa: F401
from deflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
