"""All registered queries of the library."""

from . import book_queries, expectation_queries, filing_queries, ledger_queries, metric_queries, more_queries, portfolio_queries, regime_queries, research_queries, stock_queries, study_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
