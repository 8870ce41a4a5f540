"""The four output tables of the runs, as Parquet below one root folder.

Every run writes to folders of its own (``run_id=<n>``). Its clean, quarantined and audit rows carry the attempt
that wrote them, and a marker written at the end of the attempt names it. Readers see the rows of the last marked
attempt of each run, so a run that is under way or was killed shows nothing, and one that is repeated shows its
earlier rows until all new ones are there. Rows that carry no attempt, written in bulk by other jobs, are always seen.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendery.contract import Contract
from mendery.operators.diagnose import DIAGNOSIS_TYPE
from mendery.plans.analytics import with_resolutions
from mendery.plans.running import TOTALS, merge_sums, run_sums
from mendery.session import remove_path

_HISTORY = DIAGNOSIS_TYPE.removeprefix("struct<").removesuffix(">")

RUNS = (
    "started_at timestamp, finished_at timestamp, row_count bigint, clean_first_pass bigint, healed bigint, "
    "quarantined bigint, error_types map<string,bigint>, fixes_applied map<string,bigint>, "
    "avg_time_to_heal_ms double, status string, run_id bigint"
)
QUARANTINE = (
    "row_index bigint, original_data map<string,string>, error_type string, error_detail string, "
    f"attempt_count int, diagnosis_history array<struct<{_HISTORY.replace(':', ': ')}, row_after: map<string,string>>>, "
    "end_reason string, resolved boolean, created_at timestamp, run_id bigint"
)
AUDIT = (
    "row_index bigint, attempt_no int, row_identifier string, hypothesis string, transform_chosen string, "
    "confidence double, reasoning string, diagnosis_source string, outcome string, created_at timestamp, run_id bigint"
)
ALERTS = "quarantined_count bigint, error_types map<string,bigint>, text string, created_at timestamp, run_id bigint"
RESOLUTIONS = "run_id bigint, row_index bigint, resolved_at timestamp"
ATTEMPTS = "attempt bigint, shown_at timestamp, run_id bigint"
_ATTEMPT, _SHOWN, _MERGE = "__attempt", "__shown", "__merge"
# Markers take 16 bytes a run. Up to this many (64 MB) they are broadcast, beyond it Spark chooses the join.
BROADCAST_MARKERS = 4_000_000


def known_keys(table: DataFrame, column: str) -> DataFrame:
    """Distinct keys of a reference table."""
    return table.select(column).filter(F.col(column).isNotNull()).distinct()


def _latest(compacted: DataFrame) -> DataFrame:
    """The last row of each run that was brought together with others, maybe more than once."""
    rest = [c for c in compacted.columns if c != "run_id"]
    return compacted.groupBy("run_id").agg(F.max_by(F.struct(*rest), "finished_at").alias("row")).select("run_id", "row.*")


class Store:
    def __init__(self, spark: SparkSession, root: str, contract: Contract):
        self.spark, self.root, self.contract = spark, root.rstrip("/"), contract

    def path(self, table: str, run_id: int | None = None, part: str | None = None) -> str:
        pieces = [self.root, table]
        if run_id is not None:
            pieces.append(f"run_id={run_id}")
        if part is not None:
            pieces.append(part)
        return "/".join(pieces)

    def _load(self, schema: str, load: Callable[[str], DataFrame]) -> DataFrame:
        try:
            return load(schema)
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            return self.spark.createDataFrame([], schema)

    def _read(self, table: str, schema: str) -> DataFrame:
        return self._load(schema, lambda s: self.spark.read.schema(s).parquet(self.path(table)))

    def _rows_of_runs(self, table: str, schema: str, run_ids: list[int] | None = None) -> DataFrame:
        """Rows of marked attempts, of some runs (whose folders are read without listing the others) or of all.

        The markers are read before the files are listed: an attempt marked by then has all its files, and one
        marked later is not seen at all.
        """
        shown = self.shown(run_ids)
        path = self.path(table)
        if run_ids is not None:
            path += f"/run_id={{{','.join(map(str, run_ids))}}}"
        rows = self._load(
            f"{schema}, {_ATTEMPT} bigint",
            lambda s: self.spark.read.schema(s).option("basePath", self.path(table)).parquet(path),
        )
        if not shown:
            return rows.filter(F.col(_ATTEMPT).isNull()).drop(_ATTEMPT)
        marks = self.spark.createDataFrame(list(shown.items()), f"run_id bigint, {_SHOWN} bigint")
        if len(shown) <= BROADCAST_MARKERS:
            marks = F.broadcast(marks)
        seen = F.col(_ATTEMPT).isNull() | (F.col(_ATTEMPT) == F.col(_SHOWN))
        return rows.join(marks, "run_id", "left").filter(seen).select(
            *[c for c in rows.columns if c != _ATTEMPT]
        )

    def shown(self, run_ids: list[int] | None = None) -> dict[int, int]:
        """The attempt of each run whose rows are seen: one number per run comes to the driver, which lists the
        folders of the runs anyway."""
        marks = self._read("attempts", ATTEMPTS).unionByName(self._read("attempts_compacted", ATTEMPTS))
        if run_ids is not None:
            marks = marks.filter(F.col("run_id").isin(run_ids))
        return dict(marks.groupBy("run_id").agg(F.max("attempt")).collect())

    def new_attempt(self, run_id: int) -> int:
        """A number above those of all earlier attempts of the run that were shown."""
        return max(time.time_ns() // 1000, self.shown([run_id]).get(run_id, 0) + 1)

    def show(self, run_id: int, attempt: int) -> None:
        """Mark an attempt that has written all its rows; from now on they are what readers see of the run.

        Files of earlier attempts are removed, but for the one seen until now, which readers may have in hand.
        Markers are only added, so no reader finds the run without one.
        """
        before = self.shown([run_id]).get(run_id)
        mark = self.spark.range(1).select(F.lit(attempt).alias("attempt"), F.current_timestamp().alias("shown_at"))
        mark.write.mode("append").parquet(self.path("attempts", run_id))
        for table in ("clean", "quarantine", "audit"):
            files = self._load(
                f"{_ATTEMPT} bigint", lambda s, t=table: self.spark.read.schema(s).parquet(self.path(t, run_id))
            )
            old = (F.col(_ATTEMPT) < attempt) & (F.col(_ATTEMPT) != F.lit(before or 0))
            for (path,) in files.filter(old).select("_metadata.file_path").distinct().collect() if files.inputFiles() else ():
                remove_path(self.spark, path)

    def clean(self) -> DataFrame:
        """Accepted rows; ``origin`` tells first-pass rows from healed ones."""
        typed = ", ".join(f"{f.name} {f.rule.sql_type}" for f in self.contract.fields)
        return self._rows_of_runs(
            "clean", f"row_index bigint, {typed}, created_at timestamp, run_id bigint, origin string"
        )

    def existing_keys(self, not_run: int | None = None) -> DataFrame:
        """Unique keys of the clean store, as they stand there; a repeated run must not see itself.

        They are not reduced here: whoever looks keys up does so with the keys at hand, so that the cost
        follows the batch and not the history.
        """
        clean = self.clean()
        if not_run is not None:
            clean = clean.filter(F.col("run_id") != not_run)
        return clean.select(self.contract.unique_key)

    def accepted(self, run_id: int, attempt: int, origin: str = "first_pass") -> DataFrame:
        """Rows of one attempt of a run, marked or not, read from its own folder without listing the others."""
        typed = ", ".join(f"{f.name} {f.rule.sql_type}" for f in self.contract.fields)
        schema = f"row_index bigint, {typed}, created_at timestamp, {_ATTEMPT} bigint"
        rows = self.spark.read.schema(schema).parquet(self.path("clean", run_id, f"origin={origin}"))
        return rows.filter(F.col(_ATTEMPT) == attempt).drop(_ATTEMPT)

    def alerts(self) -> DataFrame:
        """One row per run that quarantined anything, whatever became of its delivery."""
        return self._read("alerts", ALERTS)

    def runs(self) -> DataFrame:
        """One row per run: its own folder if it has one, else what ``compact_runs`` put together."""
        live, old = self._read("runs", RUNS), self._read("runs_compacted", RUNS)
        if old.isEmpty():
            return live
        return live.unionByName(_latest(old).join(live.select("run_id"), "run_id", "left_anti"))

    def _merged(self) -> tuple[int, DataFrame]:
        """The number of the last merge into the totals, and the totals as it left them."""
        states = self._read("totals", f"{TOTALS}, {_MERGE} bigint")
        last = states.agg(F.max(_MERGE)).first()[0] or 0
        return last, states.filter(F.col(_MERGE) == last).drop(_MERGE)

    def _merged_rows(self, last: int, run_ids: list[int]) -> DataFrame:
        """The rows by which some runs count in the totals of a merge."""
        rows = self._read("runs_compacted", f"{RUNS}, {_MERGE} bigint")
        return _latest(rows.filter((F.col(_MERGE) <= last) & F.col("run_id").isin(run_ids)).drop(_MERGE))

    def run_totals(self) -> DataFrame:
        """Sums over all runs as they stand, for ``totals_of`` and ``map_totals_of`` of ``plans.running``.

        They are those of the last merge, and of the runs that have ended or were repeated since; the runs
        merged before are read only where one of them was repeated.
        """
        last, sums = self._merged()
        live = self._read("runs", RUNS)
        again = [r["run_id"] for r in live.select("run_id").distinct().collect()]
        return merge_sums(sums, run_sums(live), taken_off=run_sums(self._merged_rows(last, again)))

    def compact_runs(self) -> int:
        """Bring the rows and the markers of ended runs together in one file each, and return how many runs there were.

        A run writes a folder of its own, so that repeating it touches no other; listing very many of them
        is slow. Their folders are removed only after the file is written; a run that is repeated later has
        a folder again, which counts. Stopping in between leaves rows in both places, and the folder counts.

        Each merge has a number, which its rows carry. The totals are brought up to it from those rows alone and
        name it too, so a merge that stopped before its totals were written is made up for by the next one.
        """
        ended = [r["run_id"] for r in self._read("runs", RUNS).filter("status <> 'running'").select("run_id").collect()]
        if ended:
            last, sums = self._merged()
            numbered = self._read("runs_compacted", f"run_id bigint, {_MERGE} bigint")
            merge = max(numbered.agg(F.max(_MERGE)).first()[0] or 0, last) + 1
            rows = self._read("runs", RUNS).filter(F.col("run_id").isin(ended))
            rows.withColumn(_MERGE, F.lit(merge).cast("bigint")).coalesce(1).write.mode("append").parquet(self.path("runs_compacted"))
            added = self._read("runs_compacted", f"{RUNS}, {_MERGE} bigint").filter(F.coalesce(F.col(_MERGE), F.lit(1)) > last)
            added = _latest(added.drop(_MERGE))
            again = [r["run_id"] for r in added.select("run_id").collect()]
            sums = merge_sums(sums, run_sums(added), taken_off=run_sums(self._merged_rows(last, again)))
            sums = sums.withColumn(_MERGE, F.lit(merge).cast("bigint"))
            sums.coalesce(1).write.mode("append").parquet(self.path("totals"))
            marks = self._read("attempts", ATTEMPTS).filter(F.col("run_id").isin(ended))
            marks.coalesce(1).write.mode("append").parquet(self.path("attempts_compacted"))
            for run_id in ended:
                remove_path(self.spark, self.path("attempts", run_id))
                remove_path(self.spark, self.path("runs", run_id))
        return len(ended)

    def audit(self) -> DataFrame:
        return self._rows_of_runs("audit", AUDIT)

    def resolutions(self) -> DataFrame:
        return self._read("resolutions", RESOLUTIONS)

    def quarantine(self) -> DataFrame:
        """Quarantined rows with the current ``resolved`` flag."""
        return with_resolutions(self._rows_of_runs("quarantine", QUARANTINE), self.resolutions())

    def quarantine_of(self, run_ids: list[int]) -> DataFrame:
        """Quarantined rows of some runs, read from their folders without listing the others; resolutions of
        other runs are not joined."""
        rows = self._rows_of_runs("quarantine", QUARANTINE, run_ids)
        return with_resolutions(rows, self.resolutions().filter(F.col("run_id").isin(run_ids)))

    def write(
        self, frame: DataFrame, table: str, run_id: int, part: str | None = None, attempt: int | None = None
    ) -> None:
        """Write rows of a run: beside those of its other attempts, or without an attempt in place of all."""
        rows = frame.drop("run_id")
        if table == "clean" and self.contract.unique_key:
            rows = rows.sortWithinPartitions(self.contract.unique_key)  # see ``held_keys``
        if attempt is None:
            rows.write.mode("overwrite").parquet(self.path(table, run_id, part))
        else:
            rows.withColumn(_ATTEMPT, F.lit(attempt).cast("bigint")).write.mode("append").parquet(self.path(table, run_id, part))

    def resolve(self, run_id: int, row_index: int) -> DataFrame:
        """Mark a quarantined row as resolved and return it; an unknown id gives no row."""
        entry = self.spark.range(1).select(
            F.lit(run_id).cast("bigint").alias("run_id"),
            F.lit(row_index).cast("bigint").alias("row_index"),
            F.current_timestamp().alias("resolved_at"),
        )
        wanted = (F.col("run_id") == run_id) & (F.col("row_index") == row_index)
        if not self._rows_of_runs("quarantine", QUARANTINE, [run_id]).filter(wanted).isEmpty():
            entry.write.mode("append").parquet(self.path("resolutions"))
        return self.quarantine().filter(wanted)
