"""All registered queries."""

from flowlens.plans import q_aggregates, q_detect, q_features, q_io, q_joins, q_streams, q_windows  # noqa: F401
from flowlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
