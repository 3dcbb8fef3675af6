"""Readers of the input tables."""

from edgewise.sources.tables import read_table

__all__ = ["read_table"]
