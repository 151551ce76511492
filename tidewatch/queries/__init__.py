"""All registered queries; importing a module registers what it defines."""

from tidewatch.queries import audit_queries, drift_queries, flow_queries, metric_queries, model_queries, shift_queries, stream_queries  # noqa: F401
from tidewatch.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
