"""In-memory and nested row sources, and the common row frame.

The *row frame* used by all operators has ``run_id``, ``row_index`` and one string column per contract
field, trimmed. A field that a row does not have is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendery.contract import Contract
from mendery.functions.text import normalise_name, strip

POSITION = ["run_id", "row_index"]


def resolve_names(columns: list[str]) -> dict[str, int]:
    """Normalised name -> position; when names collide the last column wins."""
    return {normalise_name(name): i for i, name in enumerate(columns)}


def normalise_columns(frame: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Trim and lower-case the names, trim every string value; ``keep`` columns pass unchanged."""
    places = resolve_names([c for c in frame.columns if c not in keep])
    flat = frame.select(*keep, *[c for c in frame.columns if c not in keep])
    flat = flat.toDF(*keep, *[f"__c{i}" for i in range(len(frame.columns) - len(keep))])
    return flat.select(*keep, *[strip(F.col(f"__c{i}").cast("string")).alias(n) for n, i in places.items()])


def row_frame(frame: DataFrame, contract: Contract, run_id: Column | int, row_index: Column) -> DataFrame:
    """Row frame of a table whose columns are already normalised; undeclared columns are left out."""
    run = F.lit(run_id) if isinstance(run_id, int) else run_id
    present = set(frame.columns)
    return frame.select(
        run.cast("bigint").alias("run_id"),
        row_index.cast("bigint").alias("row_index"),
        *[
            (F.col(n) if n in present else F.lit(None).cast("string")).alias(n)
            for n in contract.columns
        ],
    )


def ragged_value(raw: Column, name: str) -> Column:
    """Trimmed value of a key of a ``map<string,string>``, keys compared normalised, last one wins."""
    hits = F.filter(F.map_entries(raw), lambda e: F.lower(strip(e["key"])) == name)
    return strip(F.try_element_at(hits, F.lit(-1))["value"])


def ragged_row_frame(
    frame: DataFrame, contract: Contract, raw: str = "raw", run_id: str = "run_id", row_index: str = "row_index"
) -> DataFrame:
    """Row frame of rows given as ``map<string,string>``, which may differ in their keys."""
    return frame.select(
        F.col(run_id).cast("bigint").alias("run_id"),
        F.col(row_index).cast("bigint").alias("row_index"),
        *[ragged_value(F.col(raw), n).alias(n) for n in contract.columns],
    )
