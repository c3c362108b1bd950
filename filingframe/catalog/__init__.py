"""Named queries with the SQL they are checked against."""

from . import disclosures, filings, newsfeed, pages, prices, statements, streams, texts  # noqa: F401
from .registry import QUERIES, ROWS_ONLY, SQL

__all__ = ["QUERIES", "ROWS_ONLY", "SQL"]
