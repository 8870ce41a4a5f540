"""Pages of the quarantine by continuation: a page is found from the last row of the page before.

An offset has to order everything in front of a page. Here the runs table, one small row per run, says in which
order runs come and which of them can hold quarantined rows; only the folders of the runs that a page touches
are read, and resolutions are joined to their rows alone.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendery.plans.analytics import check_page
from mendery.sources.tables import QUARANTINE, Store

# Runs that are read at a time, doubled while a page is not full: few passes even where most rows are resolved.
FIRST_RUNS, MOST_RUNS = 4, 1024


class Mark(NamedTuple):
    """The last row of a page; the next page begins after it."""

    run_id: int
    row_index: int


def mark_of(page: DataFrame) -> Mark | None:
    """Where the page after this one begins, or None if this one is empty."""
    last = page.tail(1)
    return Mark(last[0]["run_id"], last[0]["row_index"]) if last else None


def seek_quarantine(
    store: Store, run_id: int | None = None, resolved: bool | None = None, limit: int = 50, after: Mark | None = None
) -> DataFrame:
    """Quarantined rows, newest run first, then by falling row index, as the pages by offset have them.

    ``after`` is the mark of the page before; without it the first page is given. A mark whose run is gone
    gives no rows. The rows of a page, 500 at most, come to the driver; runs that ended without quarantined
    rows are passed over unread, and unfinished or failed ones are looked into.
    """
    check_page(limit, 0)
    at = F.coalesce(F.col("started_at"), F.lit("0001-01-01 00:00:00").cast("timestamp"))
    runs = store.runs().filter((F.col("quarantined") > 0) | (F.col("status") != "completed"))
    if run_id is not None:
        runs = runs.filter(F.col("run_id") == run_id)
    order = F.struct(at.alias("at"), F.col("run_id").alias("id"))
    runs = runs.select("run_id", order.alias("place"))
    if after is not None:
        found = runs.filter(F.col("run_id") == after.run_id).collect()
        if not found:
            return store.spark.createDataFrame([], QUARANTINE)
        place = found[0]["place"]
        runs = runs.filter(F.col("place") <= F.struct(F.lit(place["at"]).alias("at"), F.lit(place["id"]).cast("bigint").alias("id")))
    rows, seen, width = [], 0, FIRST_RUNS
    while len(rows) < limit:
        ids = [r["run_id"] for r in runs.orderBy(F.col("place").desc()).offset(seen).limit(width).collect()]
        if not ids:
            break
        part = store.quarantine_of(ids)
        if after is not None:
            part = part.filter((F.col("run_id") != after.run_id) | (F.col("row_index") < after.row_index))
        if resolved is not None:
            part = part.filter(F.col("resolved") == resolved)
        newest = F.array_position(F.array(*[F.lit(i).cast("bigint") for i in ids]), F.col("run_id"))
        rows += part.orderBy(newest, F.col("row_index").desc()).limit(limit - len(rows)).collect()
        seen, width = seen + len(ids), min(2 * width, MOST_RUNS)
    return store.spark.createDataFrame(rows, QUARANTINE)
