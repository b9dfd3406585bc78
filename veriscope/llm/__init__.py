"""Operators that prepare training data for language models."""

from veriscope.llm.queries import QUERIES
from veriscope.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]
