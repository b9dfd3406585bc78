"""Spark-first analytics for screening financial-statement and audit text.

Every operator takes and returns DataFrames (or builds Columns), so that Catalyst plans the
whole query; Python runs only where Spark has no expression for the semantics.
"""

from veriscope.session import checkpoint_dir, get_spark, staged, table

__all__ = ["checkpoint_dir", "get_spark", "staged", "table"]
