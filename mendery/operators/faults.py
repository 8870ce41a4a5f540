"""Fault injection into clean tables, for drills and tests.

Rows and faults are picked by a hash of (seed, key), so the result depends neither on partitioning nor
on the order of the rows, and a recomputed partition gives the same rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendery.contract import Contract

# The faults and what they write.
MODES = (
    "schema_drift",
    "type_mismatch",
    "date_format_swap",
    "encoding_issue",
    "null_required_field",
    "invalid_foreign_key",
)
DRIFT_COLUMN, DRIFT_TEXT = "internal_notes", "flagged for review"
BAD_AMOUNTS = ("fifty-two", "N/A", "$49.99")
MOJIBAKE = "áéíóú".encode().decode("latin-1")
FIRST_UNKNOWN, UNKNOWN_KEYS = 9000, 1000


def pick(key: Column, seed: int, salt: str, n: int) -> Column:
    """Even choice from 0 to n-1, by 48 bits of a hash that other engines have too."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), key))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") % F.lit(n)


def drift_value(when: Column) -> Column:
    return F.when(when, F.lit(DRIFT_TEXT))


def add_drift(frame: DataFrame) -> DataFrame:
    return frame.withColumn(DRIFT_COLUMN, F.lit(DRIFT_TEXT))


def bad_amount(choice: Column) -> Column:
    """One of the texts that are no amount, by a choice from 0."""
    return F.element_at(F.array(*[F.lit(x) for x in BAD_AMOUNTS]), (choice + 1).cast("int"))


def swapped_date(value: Column) -> Column:
    """ISO text to DD/MM/YYYY."""
    return F.date_format(value.try_cast("date"), "dd/MM/yyyy")


def mojibake(value: Column) -> Column:
    return F.concat(value, F.lit(MOJIBAKE))


def misread(value: Column) -> Column:
    """Text as it looks after UTF-8 bytes are read as Latin-1."""
    return F.decode(F.encode(value, "UTF-8"), "ISO-8859-1")


def blank_one(frame: DataFrame, columns: list[str], choice: Column) -> DataFrame:
    """Blank the column that ``choice`` (from 0) names; NULL choices leave the row alone."""
    chosen = frame.withColumn("__choice", choice)
    blanked = {c: F.when(F.col("__choice") == i, F.lit("")).otherwise(F.col(c)) for i, c in enumerate(columns)}
    return chosen.withColumns(blanked).drop("__choice")


def unknown_key(prefix: str, choice: Column) -> Column:
    return F.concat(F.lit(prefix), (F.lit(FIRST_UNKNOWN) + choice).cast("string"))


def inject(
    frame: DataFrame,
    contract: Contract,
    key: str,
    rate: float,
    mode: str | None = None,
    seed: int = 0,
    key_prefix: str = "CUST-",
) -> DataFrame:
    """Corrupt about ``rate`` of the rows, with one mode or a mix, and label them.

    Adds ``injected_mode`` (NULL for untouched rows). The drift column is present only if drift can
    occur, and empty except on drifted rows.
    """
    if not 0 <= rate <= 1:
        raise ValueError("rate must be between 0 and 1")
    if mode is not None and mode not in MODES:
        raise ValueError(f"Unknown fault mode {mode!r}")
    k = F.col(key).cast("string")
    hit = pick(k, seed, "hit", 1_000_000) / 1_000_000 < F.lit(float(rate))
    names = F.array(*[F.lit(m) for m in MODES])
    which = F.lit(mode) if mode else F.element_at(names, (pick(k, seed, "mode", len(MODES)) + 1).cast("int"))
    out = frame.withColumn("injected_mode", F.when(hit, which))
    is_mode = {m: F.col("injected_mode") == m for m in MODES}

    # choices hang on the key, which a fault may rewrite below
    out = out.withColumns(
        {
            "__amount": pick(k, seed, "amount", len(BAD_AMOUNTS)),
            "__blank": F.when(
                is_mode["null_required_field"], pick(k, seed, "blank", len(contract.columns))
            ),
            "__unknown": pick(k, seed, "unknown", UNKNOWN_KEYS),
        }
    )
    changes = {
        "amount": F.when(is_mode["type_mismatch"], bad_amount(F.col("__amount"))).otherwise(F.col("amount")),
        "order_date": F.when(is_mode["date_format_swap"], swapped_date(F.col("order_date"))).otherwise(
            F.col("order_date")
        ),
        contract.unique_key: F.when(is_mode["encoding_issue"], mojibake(F.col(contract.unique_key))).otherwise(
            F.col(contract.unique_key)
        ),
        contract.foreign_key: F.when(
            is_mode["invalid_foreign_key"], unknown_key(key_prefix, F.col("__unknown"))
        ).otherwise(F.col(contract.foreign_key)),
    }
    out = blank_one(out.withColumns(changes), sorted(contract.columns), F.col("__blank"))
    if mode in (None, "schema_drift"):
        out = out.withColumn(DRIFT_COLUMN, drift_value(is_mode["schema_drift"]))
    return out.drop("__amount", "__blank", "__unknown")
