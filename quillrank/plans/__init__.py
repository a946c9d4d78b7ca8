"""Named queries with their SQL.  Importing this package registers all of them."""

from . import corpus_queries, extract_queries, flow_queries, graph_queries, retrieval_queries, service_queries, skill_queries, strategy_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
