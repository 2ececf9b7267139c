"""Structured Streaming operators: cell-edit stream (T1), session stream."""
