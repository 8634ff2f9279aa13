"""All registered queries of the library."""

from assaymill.plans import balance_queries, fold_queries, matrix_queries, model_queries, more_queries, tail_queries  # noqa: F401
from assaymill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
