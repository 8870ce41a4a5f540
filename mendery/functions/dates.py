"""Date acceptance and the date transform.

Texts are taken apart with patterns and checked with ``try_cast``: formatter-based parsing raises an
exception inside the JVM for every text it rejects, which is slow where most texts are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mendery.functions.text import SPACE_CLASS

_ISO = r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
_ISO_TIME = (
    r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt _]"
    r"(?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:[.,][0-9]+)?)?"
    r"(?:[Zz]|[+−-](?:[01][0-9]|2[0-3]):?[0-5][0-9])?\z"
)
_ISO_MIDNIGHT = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt _]00:00(?::00(?:[.,](?:0{1,6}|0{6}[0-9]+))?)?"
    r"(?:[Zz]|[+−-][0-9]{2}:?[0-9]{2})?\z"
)
_UNIX = r"^[+-]?[0-9]{1,15}(?:[.][0-9]*)?\z"
# Texts of a Unix time up to this size are seconds, larger ones milliseconds.
_SECONDS_LIMIT = 20_000_000_000
# 0001-01-01 and 9999-12-31 as days from 1970-01-01
_FIRST_DAY, _LAST_DAY = -719_162, 2_932_896


def _unix_days(value: Column) -> Column:
    number = F.regexp_extract(value, r"^([+-]?[0-9]+)", 1).try_cast("bigint")
    per_day = F.when(F.abs(number) <= _SECONDS_LIMIT, F.lit(86_400)).otherwise(F.lit(86_400_000))
    days = (number / per_day).cast("bigint")
    whole = ~value.rlike("[.]0*[1-9]")
    return F.when(whole & (number % per_day == 0) & days.between(_FIRST_DAY, _LAST_DAY), days)


def date_failure(value: Column) -> Column:
    """Error kind of a text that should be a calendar date, NULL when acceptable."""
    day = F.substring(value, 1, 10).try_cast("date")
    return (
        F.when(value.rlike(_ISO) & value.try_cast("date").isNotNull(), F.lit(None).cast("string"))
        .when(
            value.rlike(_ISO_TIME) & day.isNotNull(),
            F.when(~value.rlike(_ISO_MIDNIGHT), F.lit("date_from_datetime_inexact")),
        )
        .when(
            value.rlike(_UNIX),
            F.when(_unix_days(value).isNull(), F.lit("date_from_datetime_inexact")),
        )
        .otherwise(F.lit("date_from_datetime_parsing"))
    )


def date_value(value: Column) -> Column:
    """Typed value of an accepted text."""
    return F.when(
        value.rlike(_UNIX), F.date_add(F.lit("1970-01-01").cast("date"), _unix_days(value).cast("int"))
    ).otherwise(F.substring(value, 1, 10).try_cast("date"))


def _real_day(year: Column, month: Column, day: Column) -> Column:
    """ISO text of a date that exists in the calendar, else NULL."""
    iso = F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(F.ltrim(day), 2, "0"))
    return F.when(iso.try_cast("date").isNotNull(), iso)


def _full_year(two_digits: Column) -> Column:
    """Two-digit years 69 to 99 belong to the 1900s, 00 to 68 to the 2000s."""
    return F.concat(F.when(two_digits >= "69", F.lit("19")).otherwise(F.lit("20")), two_digits)


# English names of months; the first three letters are the short form.
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)


def _month_number(name: Column) -> Column:
    short = F.lower(F.substring(name, 1, 3))
    return F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), short).cast("string")


_Y, _M, _D = r"((?!0000)[0-9]{4})", r"([0-9]{1,2})", r"( ?[0-9]|[0-9]{2})"
_NAME = (
    "(january|february|march|april|may|june|july|august|september|october|november|december"
    "|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)"
)
_GAP = f"[{SPACE_CLASS}]+"
_CLOCK = r"(?:2[0-3]|[01]?[0-9]):[0-5]?[0-9]:[0-5]?[0-9]"


def reformat_date(value: Column, field: str | None = None) -> Column:
    """ISO text of a date written in one of the twelve known layouts, else NULL.

    The layouts fall into families that exclude each other, so only the two slash families need an
    order: day first, then month first.
    """

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(value, pattern, group)

    slash = rf"^{_D}/{_D}/{_Y}\z"
    slash_short = rf"^{_D}/{_D}/([0-9]{{2}})\z"
    year_first = rf"^{_Y}/{_M}/{_D}\z"
    dash, dot = rf"^{_D}-{_M}-{_Y}\z", rf"^{_D}[.]{_M}[.]{_Y}\z"
    clock = rf"^{_Y}-{_M}-{_D}[Tt]{_CLOCK}\z"
    name_first = rf"(?i)^{_NAME}{_GAP}{_D},{_GAP}{_Y}\z"
    day_first = rf"(?i)^{_D}{_GAP}{_NAME}{_GAP}{_Y}\z"

    def either_order(pattern: str, year: Column) -> Column:
        first, second = part(pattern, 1), part(pattern, 2)
        return F.coalesce(
            F.when(~second.startswith(" "), _real_day(year, second, first)),
            F.when(~first.startswith(" "), _real_day(year, first, second)),
        )

    return (
        F.when(value.rlike(slash), either_order(slash, part(slash, 3)))
        .when(value.rlike(dash), _real_day(part(dash, 3), part(dash, 2), part(dash, 1)))
        .when(
            value.rlike(year_first),
            _real_day(part(year_first, 1), part(year_first, 2), part(year_first, 3)),
        )
        .when(value.rlike(slash_short), either_order(slash_short, _full_year(part(slash_short, 3))))
        .when(value.rlike(dot), _real_day(part(dot, 3), part(dot, 2), part(dot, 1)))
        .when(value.rlike(clock), _real_day(part(clock, 1), part(clock, 2), part(clock, 3)))
        .when(
            value.rlike(name_first),
            _real_day(part(name_first, 3), _month_number(part(name_first, 1)), part(name_first, 2)),
        )
        .when(
            value.rlike(day_first),
            _real_day(part(day_first, 3), _month_number(part(day_first, 2)), part(day_first, 1)),
        )
    )
