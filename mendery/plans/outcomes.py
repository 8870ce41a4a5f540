"""From checked and repaired rows to the output tables of a run, or of many runs in one plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendery.contract import ORDERS, Contract, TransformRegistry, built_in_transforms
from mendery.operators.checks import (
    FACTS,
    all_errors,
    attach_facts,
    claim_facts,
    first_pass,
    invalid_rows,
    is_duplicate,
    is_healed_collision,
    valid_rows,
)
from mendery.operators.diagnose import duplicate_diagnosis
from mendery.operators.repair import MAX_ATTEMPTS, attempt_type, repair_rows
from mendery.session import settle_table

HEALED, NO_FIX, STILL_INVALID = "healed", "no_fix", "still_invalid"


@dataclass(frozen=True)
class Rules:
    """How rows are judged and repaired."""

    contract: Contract = ORDERS
    registry: TransformRegistry | None = None
    max_attempts: int = MAX_ATTEMPTS
    recheck_duplicates: bool = False

    @property
    def transforms(self) -> TransformRegistry:
        return self.registry or built_in_transforms(self.contract)


def duplicate_attempt(contract: Contract) -> Column:
    """The single attempt of a duplicate row: no fix is ever proposed."""
    d = duplicate_diagnosis(contract)
    row = "struct<" + ",".join(f"{n}:string" for n in contract.columns) + ">"
    entry = F.struct(
        *[d[k].alias(k) for k in ("hypothesis", "transform", "confidence", "reasoning", "source")],
        F.lit(None).cast(row).alias("row_after"),
    )
    return F.array(entry).cast(attempt_type(contract))


def untouched(valid: DataFrame, contract: Contract) -> DataFrame:
    """Valid rows in the shape of repaired ones."""
    return valid.withColumns(
        {
            "healed": F.lit(False),
            "end_reason": F.lit(None).cast("string"),
            "attempts": F.array().cast(attempt_type(contract)),
            "final": F.struct(*contract.columns),
        }
    )


def settle(
    repaired: DataFrame, rules: Rules, existing: DataFrame | None = None, across_runs: bool = True
) -> DataFrame:
    """Decide where every row goes: ``disposition`` is ``clean``, ``healed`` or ``quarantined``.

    Acceptance only needs existence, so many runs can be settled in one plan: a valid row is a
    duplicate if its key is in the store, was claimed in an earlier run, or stands on an earlier valid
    row of its run. Healed rows are checked against their own run only, unless ``recheck_duplicates``.
    """
    contract = rules.contract
    passed = F.col("error_type").isNull()
    if contract.unique_key is None:
        out = repaired.withColumns({"__dup": F.lit(False), "__hit": F.lit(False)})
    else:
        claim = F.when(passed, F.col(contract.unique_key)).when(
            F.col("healed"), F.col("final")[contract.unique_key]
        )
        claims = repaired.select(claim.alias("claim"), "run_id", "row_index", "healed").filter(
            F.col("claim").isNotNull()
        )
        facts = claim_facts(claims, existing, across_runs)
        out = attach_facts(repaired, facts, claim)
        out = out.withColumns(
            {
                "__dup": passed & is_duplicate(),
                "__hit": F.col("healed") & is_healed_collision(rules.recheck_duplicates),
            }
        ).drop(*FACTS)
    dup, hit = F.col("__dup"), F.col("__hit")
    return (
        out.withColumn("error_type", F.when(dup, F.lit(contract.duplicate_type)).otherwise(F.col("error_type")))
        .withColumns(
            {
                "healed": F.col("healed") & ~hit,
                "end_reason": F.when(dup | hit, F.lit(NO_FIX)).otherwise(F.col("end_reason")),
                "attempts": F.when(dup, duplicate_attempt(contract)).otherwise(F.col("attempts")),
                "quarantine_type": F.when(hit, F.lit(contract.duplicate_type)).otherwise(F.col("error_type")),
                "collided": hit,
            }
        )
        .withColumn(
            "disposition",
            F.when(F.col("error_type").isNull(), F.lit("clean"))
            .when(F.col("healed"), F.lit("healed"))
            .otherwise(F.lit("quarantined")),
        )
        .drop("__dup", "__hit")
    )


def outcomes(
    rows: DataFrame,
    known: DataFrame | None,
    existing: DataFrame | None = None,
    rules: Rules | None = None,
    across_runs: bool = True,
) -> DataFrame:
    """One row per input row of a row frame, for any number of runs.

    The invalid rows are repaired and written to the shared folder at once, as are the keys in question:
    both are read more than once, are far smaller than the input, and give the rest of the plan, which the
    caller runs, sizes to go by. Valid rows, the bulk, are only scanned.
    """
    rules = rules or Rules()
    checked = first_pass(rows, rules.contract, known)
    bad = repair_rows(invalid_rows(checked), rules.contract, known, rules.transforms, rules.max_attempts)
    valid = untouched(valid_rows(checked), rules.contract)
    return settle(valid.unionByName(settle_table(bad, "repairs")), rules, existing, across_runs)


# ------------------------------------------------------------------------------------ tables


def clean_rows(settled: DataFrame, contract: Contract) -> DataFrame:
    """Accepted rows, first-pass and healed, in the types of the contract."""
    final = F.col("final")
    typed = contract.typed(lambda n: final[n])
    return settled.filter(F.col("disposition") != "quarantined").select(
        "run_id", "row_index", "disposition", *[c.alias(n) for n, c in typed.items()]
    )


@lru_cache(maxsize=64)
def error_detail(contract: Contract) -> Column:
    """``field: message; field: message`` of the first pass."""
    text = F.array_join(F.transform(all_errors(contract), lambda e: F.concat(e["field"], F.lit(": "), e["msg"])), "; ")
    return F.when(text == "", F.lit("unknown error")).otherwise(text)


def quarantine_detail(contract: Contract) -> Column:
    """Error detail of a settled row; a healed row whose key was taken shows that key."""
    detail = error_detail(contract)
    if contract.unique_key is None:
        return detail
    key = contract.unique_key
    return F.when(
        F.col("collided"), F.concat(F.lit(f"{key}: Duplicate {key}: "), F.col("final")[key])
    ).otherwise(detail)


def _as_map(row: Column, contract: Contract) -> Column:
    pairs = [x for n in contract.columns for x in (F.lit(n), row[n])]
    return F.when(row.isNotNull(), F.create_map(*pairs))


def quarantine_rows(settled: DataFrame, contract: Contract) -> DataFrame:
    """Rows that could not be healed: original data, first-pass error and the diagnosis history."""
    history = F.transform(
        F.col("attempts"),
        lambda a: F.struct(
            *[a[k].alias(k) for k in ("hypothesis", "transform", "confidence", "reasoning", "source")],
            _as_map(a["row_after"], contract).alias("row_after"),
        ),
    )
    original = F.create_map(*[x for n in contract.columns for x in (F.lit(n), F.col(n))])
    return settled.filter(F.col("disposition") == "quarantined").select(
        "run_id",
        "row_index",
        original.alias("original_data"),
        F.coalesce("quarantine_type", F.lit("unknown")).alias("error_type"),
        quarantine_detail(contract).alias("error_detail"),
        F.size("attempts").alias("attempt_count"),
        history.alias("diagnosis_history"),
        F.col("end_reason").alias("end_reason"),
        F.lit(False).alias("resolved"),
    )


def row_identifier(contract: Contract) -> Column:
    key = F.col(contract.unique_key or contract.columns[0])
    return F.coalesce(F.nullif(key, F.lit("")), F.concat(F.lit("row-"), F.col("row_index").cast("string")))


def audit_rows(settled: DataFrame, contract: Contract) -> DataFrame:
    """One row per repair decision."""
    spread = settled.filter(F.size("attempts") > 0).select(
        "run_id",
        "row_index",
        "healed",
        row_identifier(contract).alias("row_identifier"),
        F.size("attempts").alias("__n"),
        F.posexplode("attempts").alias("__pos", "__a"),
    )
    a = F.col("__a")
    return spread.select(
        "run_id",
        "row_index",
        (F.col("__pos") + 1).alias("attempt_no"),
        "row_identifier",
        a["hypothesis"].alias("hypothesis"),
        a["transform"].alias("transform_chosen"),
        a["confidence"].alias("confidence"),
        a["reasoning"].alias("reasoning"),
        a["source"].alias("diagnosis_source"),
        F.when(F.col("healed") & (F.col("__pos") == F.col("__n") - 1), F.lit(HEALED))
        .when(a["transform"].isNull(), F.lit(NO_FIX))
        .otherwise(F.lit(STILL_INVALID))
        .alias("outcome"),
    )


def error_kinds(contract: Contract) -> list[str]:
    """The closed list of error types a contract can give."""
    kinds = [f"invalid_{n}" for n in contract.columns]
    if contract.foreign_key:
        kinds.append("invalid_foreign_key")
    if contract.unique_key:
        kinds.append(contract.duplicate_type)
    return kinds


def run_counts(settled: DataFrame, rules: Rules) -> DataFrame:
    """Counts and count maps per run in a single aggregation.

    Error types and transforms are closed lists, so each has its own partial sum. That needs one
    shuffle of a few rows per run, where exploding and regrouping would read the rows three times.
    """
    kinds, fixes = error_kinds(rules.contract), list(rules.transforms.ids)

    def uses(name: str) -> Column:
        return F.size(F.filter(F.col("attempts"), lambda a: a["transform"] == name)).cast("bigint")

    counted = settled.groupBy("run_id").agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col("disposition") == "clean").alias("clean_first_pass"),
        F.count_if(F.col("disposition") == "healed").alias("healed"),
        F.count_if(F.col("disposition") == "quarantined").alias("quarantined"),
        *[F.count_if(F.col("error_type") == k).alias(f"__e{i}") for i, k in enumerate(kinds)],
        *[F.sum(uses(k)).alias(f"__f{i}") for i, k in enumerate(fixes)],
    )
    return counted.select(
        "run_id",
        "row_count",
        "clean_first_pass",
        "healed",
        "quarantined",
        _count_map(kinds, "__e").alias("error_types"),
        _count_map(fixes, "__f").alias("fixes_applied"),
    )


def _count_map(names: list[str], prefix: str) -> Column:
    pairs = [x for i, k in enumerate(names) for x in (F.lit(k), F.col(f"{prefix}{i}"))]
    return F.map_filter(F.create_map(*pairs), lambda _, n: n > 0)


def counts_by_kind(settled: DataFrame) -> DataFrame:
    """Rows per run and first-pass error type, healed rows included."""
    return (
        settled.filter(F.col("error_type").isNotNull())
        .groupBy("run_id", "error_type")
        .agg(F.count("*").alias("n_rows"))
    )


def counts_by_fix(settled: DataFrame) -> DataFrame:
    """Proposals per run and transform over all attempts, failed ones included."""
    return (
        settled.select("run_id", F.explode("attempts.transform").alias("transform"))
        .filter(F.col("transform").isNotNull())
        .groupBy("run_id", "transform")
        .agg(F.count("*").alias("n_proposals"))
    )


def unreconciled(counts: DataFrame, inputs: DataFrame) -> DataFrame:
    """Runs whose rows do not land in exactly one place; must be empty.

    ``inputs`` has ``run_id`` and the number of rows that came in as ``rows_in``.
    """
    landed = F.col("clean_first_pass") + F.col("healed") + F.col("quarantined")
    return (
        inputs.join(counts, "run_id", "full")
        .withColumn("rows_out", F.coalesce(landed, F.lit(0)))
        .filter(F.coalesce(F.col("rows_in"), F.lit(0)) != F.col("rows_out"))
        .select("run_id", "rows_in", "rows_out")
    )


def alert_rows(runs: DataFrame) -> DataFrame:
    """One alert per run that put rows into quarantine."""
    listed = F.array_join(
        F.transform(
            F.array_sort(F.map_entries("error_types")),
            lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string")),
        ),
        ", ",
    )
    return runs.filter(F.col("quarantined") > 0).select(
        "run_id",
        F.col("quarantined").alias("quarantined_count"),
        "error_types",
        F.concat(
            F.lit("Run "),
            F.col("run_id").cast("string"),
            F.lit(" quarantined "),
            F.col("quarantined").cast("string"),
            F.lit(" row(s). Error types: {"),
            listed,
            F.lit("}"),
        ).alias("text"),
    )
