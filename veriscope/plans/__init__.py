"""Queries of the engine's operators over the test tables, and the SQL that checks them."""

from veriscope.plans.queries import QUERIES
from veriscope.plans.sql import SQL

__all__ = ["QUERIES", "SQL"]
