"""Whitespace handling that agrees with how Python strips text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points that Python's str.strip() removes.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# The same set as a character class body for Java regular expressions.
SPACE_CLASS = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def strip(value: Column) -> Column:
    """Trim every Unicode blank at both ends; plain ``trim`` removes only U+0020.

    ``btrim`` with a character set stays inside whole-stage code generation and looks only at the
    ends of the value, which a regular expression does not.
    """
    return F.btrim(value, F.lit(SPACE_CHARS))


def is_blank(value: Column) -> Column:
    return value.isNull() | (value == "")


def normalise_name(name: str) -> str:
    """Column names are compared trimmed and in lower case."""
    return name.strip().lower()
