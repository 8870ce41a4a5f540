"""The transform for identifiers that carry a mojibake tail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_id_tail(value: Column) -> Column:
    """Drop everything after the last ASCII letter or digit."""
    return F.regexp_replace(value, r"[^A-Za-z0-9]++\z", "")


def fix_encoding(value: Column, pattern: str) -> Column:
    """The value without its non-id tail, when that changes it and it then fits the pattern."""
    candidate = strip_id_tail(value)
    return F.when((candidate != value) & candidate.rlike(pattern), candidate)
