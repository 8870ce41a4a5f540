"""Questions over the runs, audit and quarantine tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendery.functions.labels import heal_time_text, humanise, percent, run_summary

MAX_PAGE = 500
CHART_BARS = 8


def check_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}")
    if offset < 0:
        raise ValueError("offset must not be negative")


# -------------------------------------------------------------------------------------- runs


def runs_page(runs: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Runs, newest first; planned as a top-k, not as a full sort."""
    check_page(limit, offset)
    return runs.orderBy(F.col("run_id").desc()).offset(offset).limit(limit)


def runs_total(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count("*").alias("total"))


def one_run(runs: DataFrame, run_id: int) -> DataFrame:
    return runs.filter(F.col("run_id") == run_id)


def run_sentences(runs: DataFrame) -> DataFrame:
    return runs.select(
        "run_id",
        run_summary(
            F.col("status"),
            F.col("row_count"),
            F.col("healed"),
            F.col("quarantined"),
            F.col("error_types"),
            F.col("fixes_applied"),
        ).alias("summary"),
    )


def mean_heal_time(timed: DataFrame) -> DataFrame:
    """Mean ``heal_ms`` over the healed rows of each run; NULL where nothing was healed."""
    healed = F.when(F.col("healed"), F.col("heal_ms"))
    return timed.groupBy("run_id").agg(F.avg(healed).alias("avg_time_to_heal_ms"))


def heal_times(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", heal_time_text(F.col("avg_time_to_heal_ms")).alias("heal_time"))


# ------------------------------------------------------------------------------------- audit


def audit_trail(audit: DataFrame, run_id: int) -> DataFrame:
    """Decisions of one run, by row and then in the order they were made."""
    return audit.filter(F.col("run_id") == run_id).orderBy("row_identifier", "row_index", "attempt_no")


def audit_patterns(audit: DataFrame) -> DataFrame:
    """Final decisions of each run grouped by outcome and transform, largest group first.

    The last attempt per row identifier is a ``max_by``, which combines before the shuffle; a window
    would gather all attempts of an identifier first.
    """
    order = F.struct("row_index", "attempt_no")
    last = audit.groupBy("run_id", "row_identifier").agg(
        F.max_by(
            F.struct("outcome", "transform_chosen", "diagnosis_source", "hypothesis", "reasoning"), order
        ).alias("last")
    )
    sample = F.min_by(
        F.struct("last.diagnosis_source", "last.hypothesis", "last.reasoning"), F.col("row_identifier")
    )
    return (
        last.groupBy("run_id", F.col("last.outcome").alias("outcome"), F.col("last.transform_chosen").alias("transform_chosen"))
        .agg(F.count("*").alias("n_rows"), sample.alias("sample"))
        .select(
            "run_id",
            "outcome",
            "transform_chosen",
            "n_rows",
            F.col("sample.diagnosis_source").alias("diagnosis_source"),
            F.col("sample.hypothesis").alias("sample_hypothesis"),
            F.col("sample.reasoning").alias("sample_reasoning"),
        )
        .orderBy("run_id", F.col("n_rows").desc(), "outcome", "transform_chosen")
    )


# -------------------------------------------------------------------------------- quarantine


def quarantine_filter(quarantine: DataFrame, run_id: int | None = None, resolved: bool | None = None) -> DataFrame:
    out = quarantine
    if run_id is not None:
        out = out.filter(F.col("run_id") == run_id)
    if resolved is not None:
        out = out.filter(F.col("resolved") == resolved)
    return out


def quarantine_page(
    quarantine: DataFrame,
    run_id: int | None = None,
    resolved: bool | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """Quarantined rows, newest first; (run_id, row_index) is the row's id and breaks ties."""
    check_page(limit, offset)
    newest = ["created_at"] if "created_at" in quarantine.columns else []
    keys = [F.col(c).desc() for c in [*newest, "run_id", "row_index"]]
    return quarantine_filter(quarantine, run_id, resolved).orderBy(*keys).offset(offset).limit(limit)


def quarantine_count(quarantine: DataFrame, run_id: int | None = None, resolved: bool | None = None) -> DataFrame:
    return quarantine_filter(quarantine, run_id, resolved).agg(F.count("*").alias("total"))


def one_quarantine_row(quarantine: DataFrame, run_id: int, row_index: int) -> DataFrame:
    return quarantine.filter((F.col("run_id") == run_id) & (F.col("row_index") == row_index))


def with_resolutions(quarantine: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Current state of the ``resolved`` flag.

    Resolutions are only ever appended, as (run_id, row_index); ids that match nothing change nothing.
    """
    done = resolutions.select("run_id", "row_index").distinct().withColumn("__done", F.lit(True))
    joined = quarantine.join(done, ["run_id", "row_index"], "left")
    flag = F.col("resolved") | F.coalesce(F.col("__done"), F.lit(False))
    return joined.withColumn("resolved", flag).select(*quarantine.columns)


def tab_counts(quarantine: DataFrame) -> DataFrame:
    """Unresolved, resolved and all rows in one pass."""
    return quarantine.agg(
        F.count_if(~F.col("resolved")).alias("unresolved"),
        F.count_if(F.col("resolved")).alias("resolved"),
        F.count("*").alias("all_rows"),
    )


def quarantine_by_type(quarantine: DataFrame) -> DataFrame:
    """Quarantined rows per error type over the full table, largest group first."""
    return (
        quarantine.groupBy("error_type")
        .agg(F.count("*").alias("n_rows"), F.count_if(~F.col("resolved")).alias("n_unresolved"))
        .withColumn("label", humanise(F.col("error_type")))
        .orderBy(F.col("n_rows").desc(), "error_type")
    )


# ------------------------------------------------------------------------------------- stats


def completed(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("status") == "completed")


def totals(runs: DataFrame) -> DataFrame:
    """Totals and heal rates over completed runs; rates are 0.0 where nothing can be divided."""
    sums = completed(runs).agg(
        F.count("*").alias("total_runs"),
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(alias)
            for c, alias in (
                ("row_count", "total_rows_processed"),
                ("clean_first_pass", "total_clean_first_pass"),
                ("healed", "total_healed"),
                ("quarantined", "total_quarantined"),
            )
        ],
    )
    return with_rates(sums)


def with_rates(sums: DataFrame) -> DataFrame:
    """Add the heal rates to the one row of totals."""
    clean, healed = F.col("total_clean_first_pass"), F.col("total_healed")
    overall = F.try_divide((clean + healed).cast("double"), F.col("total_rows_processed").cast("double"))
    auto = F.try_divide(healed.cast("double"), (healed + F.col("total_quarantined")).cast("double"))
    return sums.withColumns(
        {
            "overall_heal_rate": F.coalesce(overall, F.lit(0.0)),
            "auto_heal_rate": F.coalesce(auto, F.lit(0.0)),
        }
    )


def heal_rate_over_time(runs: DataFrame) -> DataFrame:
    rate = F.try_divide(
        (F.col("clean_first_pass") + F.col("healed")).cast("double"), F.col("row_count").cast("double")
    )
    return (
        completed(runs)
        .select(
            "run_id",
            F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss").alias("started_at"),
            F.coalesce(rate, F.lit(0.0)).alias("heal_rate"),
            "row_count",
        )
        .orderBy("run_id")
    )


def heal_rate_chart(runs: DataFrame) -> DataFrame:
    """Chart points: run label, heal rate in percent, rows."""
    return heal_rate_over_time(runs).select(
        "run_id",
        F.concat(F.lit("#"), F.col("run_id").cast("string")).alias("run"),
        percent(F.col("heal_rate")).alias("heal_rate_pct"),
        "row_count",
    )


def map_totals(runs: DataFrame, column: str) -> DataFrame:
    """Sum of a count map by key over completed runs."""
    return (
        completed(runs)
        .select(F.explode(column).alias("key", "n"))
        .groupBy("key")
        .agg(F.sum("n").alias("total"))
    )


def breakdown(totals_by_key: DataFrame, bars: int = CHART_BARS) -> DataFrame:
    """The largest entries with display labels; ties by key."""
    return (
        totals_by_key.orderBy(F.col("total").desc(), "key")
        .limit(bars)
        .select("key", humanise(F.col("key")).alias("label"), "total")
    )
