"""Readers of the input tables."""

from lodestone.sources.tables import table

__all__ = ["table"]
