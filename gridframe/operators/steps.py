"""A transform step of a sheet with its report and its version.

A step is a function of the sheet's DataFrame.  Its result is evaluated once,
re-indexed (A1), compared with the sheet before (D1) and committed to the
sheet's version log (H1).  If any of it fails, nothing has been committed and
the sheet before is still the current one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from gridframe.operators.diff import modified_cells
from gridframe.operators.history import VersionLog
from gridframe.sheet import Sheet


@dataclass
class StepResult:
    sheet: Sheet
    touched: DataFrame  # (row, col) of the cells that the step modified


def run_step(
    sheet: Sheet,
    fn: Callable[[DataFrame], DataFrame],
    log: VersionLog | None = None,
    order_by: list[str | Column] | None = None,
) -> StepResult:
    """Apply ``fn`` to ``sheet``; commit the result to ``log`` if there is one."""
    out = sheet.transform(fn, order_by)
    touched = modified_cells(sheet, out)
    if log is not None:
        log.commit(out)
    return StepResult(out, touched)
