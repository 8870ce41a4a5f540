"""Display texts for runs, error kinds and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The texts of this module are fixed values: they must read as they do on the dashboard they stand in for.


def humanise(raw: Column) -> Column:
    """``duplicate_order_id`` becomes ``Duplicate order ID``."""
    words = F.transform(F.split(raw, "_"), lambda w: F.when(w == "id", F.lit("ID")).otherwise(w))
    text = F.array_join(words, " ")
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2_000_000_000))


def heal_time_text(ms: Column) -> Column:
    """Milliseconds per row, with more digits for smaller numbers."""
    return (
        F.when(ms == 0, F.lit("0 ms/row"))
        .when(ms < 1, F.format_string("%.2f ms/row", ms))
        .when(ms < 10, F.format_string("%.1f ms/row", ms))
        .otherwise(F.concat(F.floor(ms + 0.5).cast("string"), F.lit(" ms/row")))
    )


def percent(rate: Column) -> Column:
    """Rate as a percentage with one decimal, halves rounded up."""
    return F.floor(rate * 1000 + 0.5).cast("double") / 10


def top_entry(counts: Column) -> Column:
    """Key with the largest count of a ``map<string,bigint>``; ties go to the smaller key."""
    ranked = F.array_sort(
        F.transform(
            F.map_entries(counts),
            lambda e: F.struct((-e["value"]).alias("order"), e["key"].alias("key")),
        )
    )
    return F.try_element_at(ranked, F.lit(1))["key"]


def run_summary(
    status: Column, row_count: Column, healed: Column, quarantined: Column, errors: Column, fixes: Column
) -> Column:
    """One sentence about a run."""
    broken = healed + quarantined
    top_error, top_fix = top_entry(errors), top_entry(fixes)
    head = F.concat(
        broken.cast("string"),
        F.when(broken == 1, F.lit(" row")).otherwise(F.lit(" rows")),
        F.lit(" had errors ("),
        F.coalesce(F.concat(F.lit("mostly "), F.lower(humanise(top_error))), F.lit("mixed causes")),
        F.lit(")"),
    )
    fixed = F.when(
        healed > 0,
        F.concat(
            healed.cast("string"),
            F.lit(" auto-fixed"),
            F.coalesce(F.concat(F.lit(" (mainly "), F.lower(humanise(top_fix)), F.lit(")")), F.lit("")),
        ),
    )
    kept = F.when(quarantined > 0, F.concat(quarantined.cast("string"), F.lit(" quarantined")))
    return (
        F.when(
            status == "rejected_schema_drift",
            F.lit("Batch rejected: unexpected column(s) in the CSV (schema drift)."),
        )
        .when(status == "failed", F.lit("Run failed unexpectedly partway through."))
        .when(status == "running", F.lit("Still running..."))
        .when(
            broken == 0,
            F.concat(F.lit("All "), row_count.cast("string"), F.lit(" rows clean, no repairs needed.")),
        )
        .otherwise(F.concat(F.concat_ws(", ", head, fixed, kept), F.lit(".")))
    )
