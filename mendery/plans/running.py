"""Totals over runs that are kept up to date: sums of what is merged, so that only new runs are looked at.

A total is a small table (``measure``, ``key``, ``total``): the counts of completed runs, and the count maps by key.
Tables of different runs are added, and what a repeated run had given before is taken off.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendery.plans.analytics import completed, with_rates

COUNTS = ("row_count", "clean_first_pass", "healed", "quarantined")
MAPS = ("error_types", "fixes_applied")
TOTALS = "measure string, key string, total bigint"


def _entry_of(measure: str) -> Callable[[Column], Column]:
    return lambda e: F.struct(F.lit(measure), e["key"], e["value"])


def run_sums(runs: DataFrame) -> DataFrame:
    """What some runs, one row each, give to the totals; runs that are not completed give nothing."""
    entry = "array<struct<measure: string, key: string, n: bigint>>"
    counts = [F.struct(F.lit("runs"), F.lit(""), F.lit(1).cast("bigint"))]
    counts += [F.struct(F.lit(c), F.lit(""), F.col(c).cast("bigint")) for c in COUNTS]
    maps = [F.coalesce(F.transform(F.map_entries(m), _entry_of(m)), F.array()) for m in MAPS]
    entries = F.concat(*[p.cast(entry) for p in (F.array(*counts), *maps)])
    return completed(runs).select(F.inline(entries)).groupBy("measure", "key").agg(F.sum("n").alias("total"))


def merge_sums(*added: DataFrame, taken_off: DataFrame | None = None) -> DataFrame:
    """Sums of several totals, less one; keys that nothing is left of go."""
    parts = [a.select("measure", "key", "total") for a in added]
    if taken_off is not None:
        parts.append(taken_off.select("measure", "key", (-F.col("total")).alias("total")))
    whole = reduce(DataFrame.unionByName, parts)
    return whole.groupBy("measure", "key").agg(F.sum("total").alias("total")).filter("total <> 0")


def totals_of(sums: DataFrame) -> DataFrame:
    """The row that ``analytics.totals`` gives over the runs themselves."""

    def of(measure: str):
        return F.coalesce(F.sum(F.when(F.col("measure") == measure, F.col("total"))), F.lit(0))

    names = ("total_rows_processed", "total_clean_first_pass", "total_healed", "total_quarantined")
    return with_rates(
        sums.agg(of("runs").alias("total_runs"), *[of(c).alias(n) for c, n in zip(COUNTS, names, strict=True)])
    )


def map_totals_of(sums: DataFrame, column: str) -> DataFrame:
    """The rows that ``analytics.map_totals`` gives over the runs themselves."""
    return sums.filter(F.col("measure") == column).select("key", "total")
