"""Decimal acceptance and the amount transform.

A cast alone cannot decide whether a value is acceptable: ``try_cast('49.123' AS decimal(12,2))``
rounds. Digits are therefore counted on the text first, and only accepted text is cast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mendery.functions.text import SPACE_CLASS

_NUMBER = r"^([+-]?)([0-9]*)[.]?([0-9]*)(?:[eE]([+-]?[0-9]{1,9}))?\z"
_HAS_MANTISSA = r"^[+-]?[.]?[0-9]"
_NOT_FINITE = r"(?i)^[+-]?(?:inf|infinity|s?nan[0-9]*)\z"
_POSITIVE = r"^[+]?(?=[0-9.]*[1-9])(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?\z"
_POSITIVE_INFINITY = r"(?i)^[+]?inf(?:inity)?\z"


def decimal_failure(value: Column, precision: int, scale: int) -> Column:
    """Error kind of a text that should be a positive decimal, NULL when acceptable.

    Plain notation is settled by one pattern. Exponents, signs, underscores and over-long digit strings
    take a slower branch, which a CASE evaluates only for the rows that reach it. Everything here has
    generated code, and stays short: a higher-order function, or a method that grows too long, would take the
    whole projection out of code generation.
    """
    whole = precision - scale
    plain = value.rlike(rf"^(?=[0-9.]*[1-9])[0-9]{{1,{whole}}}(?:[.][0-9]{{1,{scale}}})?\z")
    return F.when(~plain, _digit_failure(F.replace(value, F.lit("_"), F.lit("")), precision, scale))


def _digit_failure(text: Column, precision: int, scale: int) -> Column:
    # an exponent is written out by a decimal wide enough for every number that could still be accepted
    written = F.when(text.rlike("[eE]"), text.try_cast("decimal(38,18)").cast("string")).otherwise(text)
    unsigned = F.ltrim(written, F.lit("+-0"))
    # no sign, no zeros before the whole part, none after the fraction
    digits = F.when(unsigned.contains("."), F.rtrim(F.rtrim(unsigned, F.lit("0")), F.lit("."))).otherwise(unsigned)
    places = F.when(digits.contains("."), F.length(F.substring_index(digits, ".", -1))).otherwise(F.lit(0))
    return (
        F.when(text.rlike(_NOT_FINITE), F.lit("finite_number"))
        .when(~(text.rlike(_NUMBER) & text.rlike(_HAS_MANTISSA)), F.lit("decimal_parsing"))
        .when(~text.rlike("^[^eE]*[1-9]"), F.lit("greater_than"))
        # a number that the decimal cannot hold, or holds as zero, has more digits than any that is accepted
        .when(digits.isNull() | (digits == ""), F.lit("decimal_max_digits"))
        .when(F.length(F.replace(digits, F.lit("."), F.lit(""))) > precision, F.lit("decimal_max_digits"))
        .when(places > scale, F.lit("decimal_max_places"))
        .when(F.length(F.substring_index(digits, ".", 1)) > precision - scale, F.lit("decimal_whole_digits"))
        .when(text.startswith("-"), F.lit("greater_than"))
    )


def decimal_value(value: Column, precision: int, scale: int) -> Column:
    """Typed value of an accepted text (never rounds, because acceptance fixed the scale)."""
    return F.replace(value, F.lit("_"), F.lit("")).try_cast(f"decimal({precision},{scale})")


def coerce_amount(value: Column, field: str | None = None) -> Column:
    """Drop currency signs, thousands commas and blanks; NULL when that does not help.

    Nothing else is dropped: letters or brackets may carry meaning, so such values are declined.
    """
    cleaned = F.regexp_replace(value, "[$€£¥," + SPACE_CLASS + "]", "")
    number = F.replace(cleaned, F.lit("_"), F.lit(""))
    positive = number.rlike(_POSITIVE) | number.rlike(_POSITIVE_INFINITY)
    return F.when((cleaned != value) & positive, cleaned)
