"""Operators for preparing training text at scale, and their driver queries.

Nothing else in the library imports this subpackage."""
