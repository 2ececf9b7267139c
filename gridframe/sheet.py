"""The ``Sheet`` handle: a DataFrame with a contiguous ``_row`` plus an
ordered list of value columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.functions.text import qc
from gridframe.plans.ordinals import ROW, numbered, reindexed


class Sheet:
    """Ordered table.  ``df`` always carries ``_row`` (0-based, contiguous)."""

    def __init__(self, df: DataFrame, n_rows: int | None = None):
        if ROW not in df.columns:
            raise ValueError("a Sheet DataFrame needs a _row column; use Sheet.from_df")
        self.df = df.select(ROW, *[qc(c) for c in df.columns if c != ROW])
        self._n_rows = n_rows

    # -- construction -------------------------------------------------
    @classmethod
    def from_df(cls, df: DataFrame, order_by: list[str | Column] | None = None,
                materialize: bool = True) -> "Sheet":
        """A1: number rows 0..n-1 in ``order_by`` order (distributed)."""
        return cls(*numbered(df, order_by, ROW, materialize))

    def reindexed(self) -> "Sheet":
        """A1 after an edit that left gaps in ``_row``: renumber keeping order."""
        return Sheet.from_df(self.df, [F.col(ROW)])

    # -- metadata (S7) ------------------------------------------------
    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != ROW]

    @property
    def n_cols(self) -> int:
        return len(self.columns)

    @property
    def n_rows(self) -> int:
        if self._n_rows is None:
            self._n_rows = self.df.count()
        return self._n_rows

    def metadata(self) -> dict:
        return {"columns": self.n_cols, "rows": self.n_rows}

    def values(self) -> DataFrame:
        """The value columns only, in sheet order (order itself is in ``_row``)."""
        return self.df.select(*[qc(c) for c in self.columns])

    # -- U1-U3 transform steps --------------------------------------
    def transform(self, fn: Callable[[DataFrame], DataFrame],
                  order_by: list[str | Column] | None = None) -> "Sheet":
        """Arbitrary DataFrame -> DataFrame step, then re-index.  The step is
        evaluated once, here (see ``operators.steps`` for U1 with its diff and
        commit).

        If the result keeps ``_row`` its order is kept; otherwise the caller
        must give ``order_by``."""
        out = fn(self.df)
        if ROW in out.columns:
            return Sheet(*reindexed(out))
        if not order_by:
            raise ValueError("the step dropped _row; give order_by to fix the row order")
        return Sheet.from_df(out, order_by)

    def sql(self, query: str, view: str = "sheet") -> "Sheet":
        """A SQL step over the sheet registered as temp view ``view``."""
        spark = self.df.sparkSession
        self.df.createOrReplaceTempView(view)
        return self.transform(lambda _: spark.sql(query))

    def map_blocks(self, fn, schema: str) -> "Sheet":
        """A pandas step per Arrow batch (``mapInPandas``); ``_row`` must
        pass through so the order survives."""
        return self.transform(lambda d: d.mapInPandas(fn, schema))

