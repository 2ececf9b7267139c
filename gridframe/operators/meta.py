"""S7 sheet metadata as a one-row DataFrame."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.sheet import Sheet


def sheet_meta(sheet: Sheet) -> DataFrame:
    """``{columns, rows}`` computed by one aggregate (no driver count)."""
    return sheet.df.agg(F.lit(sheet.n_cols).cast("bigint").alias("columns"), F.count(F.lit(1)).alias("rows"))
