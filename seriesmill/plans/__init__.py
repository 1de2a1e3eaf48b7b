"""Ready queries over the test tables, each with the SQL that it must agree with."""

from . import forwarding, ingestion, relabeling, selection
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "forwarding", "ingestion", "relabeling", "selection"]
