"""Clean values of names: one spelling per node, item or source.

All of these are built-in expressions, so they stay inside whole-stage code
generation and are evaluated during the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks, tabs and line breaks; stripped at both ends.
BLANKS = " \t\r\n"
#: A clean value that stands for "no value".
NOT_AVAILABLE = "N/A"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_name(c: Column | str) -> Column:
    """Without white space at both ends and in upper case; null stays null."""
    return F.upper(F.btrim(_column(c).cast("string"), F.lit(BLANKS)))


def present(c: Column | str) -> Column:
    """Whether a clean name is a value: not null, not empty and not ``N/A``."""
    c = _column(c)
    return c.isNotNull() & (c != "") & (c != NOT_AVAILABLE)


def clean_value(c: Column | str) -> Column:
    """The clean name, or null where it is missing."""
    name = clean_name(c)
    return F.when(present(name), name)


def clean_source(c: Column | str) -> Column:
    """A source without white space at both ends and in lower case; null and
    empty give null."""
    name = F.lower(F.btrim(_column(c).cast("string"), F.lit(BLANKS)))
    return F.when(name != "", name)
