"""All queries of the engine over the driver tables."""

from framewright.plans import count_queries, histogram_queries, model_queries, scalar_queries, stream_queries  # noqa: F401
from framewright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
