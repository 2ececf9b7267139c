"""gridframe: positional sheet editing, cleaning, profiling, diffing and
versioning on Spark DataFrames.

A *sheet* is a DataFrame with a contiguous 0-based ``_row BIGINT`` column
plus an ordered list of value columns.  Everything is expressed with the
public DataFrame / SQL / Structured Streaming API so Catalyst plans it.
"""

from gridframe.session import get_spark, checkpoint_dir, cut_lineage
from gridframe.sheet import Sheet, ROW

__all__ = ["get_spark", "checkpoint_dir", "cut_lineage", "Sheet", "ROW"]
