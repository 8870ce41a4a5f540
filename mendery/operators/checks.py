"""Validation: schema drift, contract, known keys and duplicates."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendery.contract import Contract
from mendery.functions.text import strip
from mendery.operators.lookup import below_broadcast_limit, known_flag, keyed_lookup
from mendery.session import settle_table

# Ranges of keys that a scan of the store is filtered by, and the prefix lengths that they may come from.
MOST_RANGES = 64
PREFIXES = tuple(range(1, 33))


class SchemaDriftError(Exception):
    """A batch carries columns that its contract does not declare."""

    def __init__(self, unexpected_columns: set[str]):
        self.unexpected_columns = set(unexpected_columns)
        super().__init__(f"Unexpected columns in batch: {sorted(self.unexpected_columns)}")


# ------------------------------------------------------------------------------ schema drift


def unexpected_columns(frame: DataFrame, contract: Contract, reserved: tuple[str, ...] = ()) -> set[str]:
    """Undeclared columns of a table. A table without rows never drifts."""
    extra = {c for c in frame.columns if c not in contract.columns and c not in reserved}
    return extra if extra and not frame.isEmpty() else set()


def check_drift(frame: DataFrame, contract: Contract, reserved: tuple[str, ...] = ()) -> None:
    extra = unexpected_columns(frame, contract, reserved)
    if extra:
        raise SchemaDriftError(extra)


def ragged_drift(frame: DataFrame, contract: Contract, raw: str = "raw") -> DataFrame:
    """Undeclared keys of ragged rows: ``run_id, column_name, n_rows``.

    The declared names are a literal list, so this needs one aggregation and no join.
    """
    keys = frame.select("run_id", F.explode(F.map_keys(raw)).alias("key"))
    return (
        keys.select("run_id", F.lower(strip(F.col("key"))).alias("column_name"))
        .filter(~F.col("column_name").isin(*contract.columns))
        .groupBy("run_id", "column_name")
        .agg(F.count("*").alias("n_rows"))
    )


# ---------------------------------------------------------------------------------- contract


def fail_name(field: str) -> str:
    return f"fail_{field}"


def value_of(field: str) -> Column:
    return F.col(field)


def kind_of(field: str) -> Column:
    return F.col(fail_name(field))


@lru_cache(maxsize=64)
def _failures(contract: Contract) -> dict[str, Column]:
    return {fail_name(n): c for n, c in contract.failures(value_of).items()}


def check_contract(rows: DataFrame, contract: Contract) -> DataFrame:
    """Add one ``fail_<field>`` error kind per field and ``error_type`` (NULL when the row passes)."""
    judged = rows.withColumns(_failures(contract))
    return judged.withColumn("error_type", contract.first_failure(kind_of))


def check_known(
    checked: DataFrame, contract: Contract, known: DataFrame | None
) -> DataFrame:
    """Add ``key_known`` and turn rows that pass the contract with an unknown key into FK failures."""
    if contract.foreign_key is None or known is None:
        return checked.withColumn("key_known", F.lit(True))
    flagged = known_flag(
        checked, F.col(contract.foreign_key), known, "key_known", F.struct("run_id", "row_index")
    )
    fk = F.when(~F.col("key_known"), F.lit("invalid_foreign_key"))
    return flagged.withColumn("error_type", F.coalesce("error_type", fk))


def first_pass(rows: DataFrame, contract: Contract, known: DataFrame | None) -> DataFrame:
    """Contract and foreign key checks of a row frame."""
    return check_known(check_contract(rows, contract), contract, known)


def unknown_keys(checked: DataFrame, contract: Contract, known: DataFrame) -> DataFrame:
    """Report form of the key check: rows that pass the contract and have an unknown key."""
    valid = checked.filter(F.col("error_type").isNull())
    flagged = known_flag(
        valid, F.col(contract.foreign_key), known, "__known_here", F.struct("run_id", "row_index")
    )
    return flagged.filter(~F.col("__known_here")).drop("__known_here")


def store_duplicates(checked: DataFrame, contract: Contract, existing: DataFrame) -> DataFrame:
    """Valid rows whose unique key the store already holds.

    The keys are reduced to one row each before they meet the store; what the store holds of them is
    looked up again from the rows, with hot keys kept apart.
    """
    valid = valid_rows(checked)
    key = F.col(contract.unique_key)
    claims = valid.groupBy(key.alias("claim")).agg(F.count("*").alias("n_rows"))
    claims = settle_table(claims, "claims")
    facts = claims.join(held_keys(existing, claims), "claim").withColumn("__held", F.lit(True))
    found = keyed_lookup(valid, facts, {"claim": key}, ["__held"], F.struct("run_id", "row_index"))
    return found.filter(F.col("__held")).drop("__held")


def claim_ranges(claims: DataFrame, most: int = MOST_RANGES) -> list[tuple[str, str]]:
    """At most ``most`` ranges that together hold all claims, close where the claims are close.

    Claims are grouped by the longest prefix that leaves few enough groups, so that a few claims far from the
    others do not widen the ranges of those. Only the ends of the ranges come to the driver.
    """
    claim = F.col("claim")
    sizes = claims.agg(*[F.approx_count_distinct(F.left(claim, F.lit(n))).alias(str(n)) for n in PREFIXES]).first()
    fits = [n for n in PREFIXES if sizes[str(n)] <= most]
    for n in [*reversed(fits), 0]:
        groups = claims.filter(claim.isNotNull()).groupBy(F.left(claim, F.lit(n)).alias("__prefix"))
        ends = groups.agg(F.min(claim).alias("low"), F.max(claim).alias("high")).limit(most + 1).collect()
        if len(ends) <= most:
            break
    return sorted((r["low"], r["high"]) for r in ends)


def held_keys(existing: DataFrame, claims: DataFrame) -> DataFrame:
    """Distinct claims that the store holds.

    The store is looked up from its own side: its key column is only scanned where Spark broadcasts the
    claims, which are written before and so have a known size. Where they are too many for that, Spark
    filters the scan with a Bloom filter of them. The store is never reduced or sorted as a whole.

    The ranges in which the claims lie are part of the scan's filter, so files, row groups and pages without a
    key in them are not read. Runs write their rows sorted by key in each file: where ids rise with time, and
    for small batches of any ids, what is read follows the batch and not the history.
    """
    (column,) = existing.columns
    keys = existing.select(F.col(column).alias("claim"))
    if not below_broadcast_limit(existing):
        inside = [F.col(column).between(F.lit(low), F.lit(high)) for low, high in claim_ranges(claims)]
        keys = existing.filter(reduce(Column.__or__, inside, F.lit(False))).select(F.col(column).alias("claim"))
    return keys.join(claims.select("claim").distinct(), "claim", "left_semi").distinct()


@lru_cache(maxsize=64)
def all_errors(contract: Contract) -> Column:
    """All errors of a checked row. Columns are unresolved trees, so a built one serves any number of frames."""
    return contract.errors(value_of, kind_of, F.col("error_type"))


def with_errors(checked: DataFrame, contract: Contract, name: str = "errors") -> DataFrame:
    """Add the list of all errors of the first pass."""
    return checked.withColumn(name, all_errors(contract))


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("error_type").isNull())


def invalid_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("error_type").isNotNull())


def typed_rows(checked: DataFrame, contract: Contract) -> DataFrame:
    """Valid rows in the types of the contract."""
    typed = contract.typed(value_of)
    return valid_rows(checked).select("run_id", "row_index", *[c.alias(n) for n, c in typed.items()])


# -------------------------------------------------------------------------------- duplicates


def claim_facts(
    claims: DataFrame, existing: DataFrame | None, across_runs: bool = True
) -> DataFrame:
    """Facts about unique keys that more than one row claims, or that the store already holds.

    ``claims`` has ``claim`` (the unique key), ``run_id``, ``row_index`` and ``healed``. One row comes
    back per (claim, run_id) with ``first_valid`` and ``first_healed`` (lowest row_index of each kind),
    ``taken`` (the key was in the store before the run) and ``n_rows``.

    Claims are reduced per (key, run) before any window, so a key held by a third of all rows is a
    handful of rows here. The window that looks at earlier runs sees one row per run. Keys that raise
    no question are dropped, which leaves a set that is small unless the data is mostly duplicates.
    """
    per_run = claims.groupBy("claim", "run_id").agg(
        F.min(F.when(~F.col("healed"), F.col("row_index"))).alias("first_valid"),
        F.min(F.when(F.col("healed"), F.col("row_index"))).alias("first_healed"),
        F.count("*").alias("n_rows"),
    )
    taken = F.lit(False)
    if across_runs:
        # any row of the key in an earlier run puts it in the store before this one
        earlier = Window.partitionBy("claim").orderBy("run_id")
        per_run = per_run.withColumn("__nth_run", F.row_number().over(earlier))
        taken = F.col("__nth_run") > 1
    if existing is not None:
        per_run = settle_table(per_run, "claims")
        held = held_keys(existing, per_run).withColumn("__held", F.lit(True))
        per_run = per_run.join(held, "claim", "left")
        taken = taken | F.coalesce(F.col("__held"), F.lit(False))
    return (
        per_run.withColumn("taken", taken)
        .filter(F.col("taken") | (F.col("n_rows") > 1))
        .select("claim", "run_id", "first_valid", "first_healed", "taken", "n_rows")
    )


FACTS = ["first_valid", "first_healed", "taken"]


def attach_facts(rows: DataFrame, facts: DataFrame, claim: Column) -> DataFrame:
    """Bring the claim facts to the rows; rows without a claim get NULLs."""
    return keyed_lookup(
        rows,
        facts.withColumnRenamed("run_id", "claim_run"),
        {"claim": claim, "claim_run": F.col("run_id")},
        FACTS,
        F.struct("run_id", "row_index"),
    )


def is_duplicate() -> Column:
    """A row that is otherwise valid, given its claim facts: taken, or not the first valid row."""
    return F.coalesce(F.col("taken"), F.lit(False)) | F.coalesce(
        F.col("first_valid") < F.col("row_index"), F.lit(False)
    )


def is_healed_collision(recheck: bool) -> Column:
    """A healed row whose key a row of the same run already took; ``recheck`` also asks the store."""
    taken = F.coalesce(F.col("taken"), F.lit(False))
    clean_holds_it = F.col("first_valid").isNotNull() & ~taken
    earlier_healed = F.coalesce(F.col("first_healed") < F.col("row_index"), F.lit(False))
    hit = clean_holds_it | earlier_healed
    return (hit | taken) if recheck else hit


def check_duplicates(
    checked: DataFrame, contract: Contract, existing: DataFrame | None, across_runs: bool = False
) -> DataFrame:
    """Mark valid rows whose unique key is in the store, or stands on an earlier valid row."""
    if contract.unique_key is None:
        return checked
    claim = F.when(F.col("error_type").isNull(), F.col(contract.unique_key))
    claims = valid_rows(checked).select(
        F.col(contract.unique_key).alias("claim"), "run_id", "row_index", F.lit(False).alias("healed")
    )
    facts = claim_facts(claims, existing, across_runs)
    looked_up = attach_facts(checked, facts, claim)
    duplicate = F.when(F.col("error_type").isNull() & is_duplicate(), F.lit(contract.duplicate_type))
    return looked_up.withColumn("error_type", F.coalesce("error_type", duplicate)).drop(*FACTS)
