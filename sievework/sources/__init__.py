"""Reading and writing tables and files."""

from sievework.sources.tables import load, one_each, spread, with_columns

__all__ = ["load", "one_each", "spread", "with_columns"]
