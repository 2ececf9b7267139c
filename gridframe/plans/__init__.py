"""Distributed primitives every positional operator builds on."""

from gridframe.plans.ordinals import assign_ordinals, ROW
from gridframe.plans.running import running_sum, carry_last, bucket_width

__all__ = ["assign_ordinals", "ROW", "running_sum", "carry_last", "bucket_width"]
