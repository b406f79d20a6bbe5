"""All registered queries of the library's own operators, with their SQL oracles."""

from __future__ import annotations

from . import catalog_queries, curation_queries, edit_queries, import_queries, kernel_queries, offer_queries, queue_queries, relational_queries, source_queries
from .binding import ORACLES, QUERIES

MODULES = (catalog_queries, queue_queries, offer_queries, relational_queries, curation_queries, edit_queries, import_queries, kernel_queries, source_queries)

__all__ = ["MODULES", "ORACLES", "QUERIES"]
