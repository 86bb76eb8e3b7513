"""Registered queries and their SQL."""

from affinis.plans import graph_queries, motif_queries, report_queries, robustness_queries  # noqa: F401  these register
from affinis.plans.register import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
