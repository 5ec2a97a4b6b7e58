"""All registered queries."""

from . import clean_queries, entity_queries, fleet_queries, io_queries, leak_queries, report_queries  # noqa: F401
from .book import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
