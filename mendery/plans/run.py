"""One tracked run over one batch: check, repair, write the tables, summarise."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from mendery.operators.checks import (
    FACTS,
    SchemaDriftError,
    attach_facts,
    check_drift,
    claim_facts,
    first_pass,
    invalid_rows,
    is_duplicate,
    is_healed_collision,
    typed_rows,
    valid_rows,
)
from mendery.operators.external import ClientFactory, external_diagnoser
from mendery.operators.repair import repair_rows
from mendery.operators.row_index import with_row_index
from mendery.plans.outcomes import (
    Rules,
    alert_rows,
    audit_rows,
    clean_rows,
    quarantine_rows,
    run_counts,
)
from mendery.session import scratch_space, settle_table
from mendery.sources.csv import read_csv
from mendery.sources.rows import row_frame
from mendery.sources.tables import RUNS, Store

logger = logging.getLogger(__name__)

AlertSink = Callable[[Row], None]


class BatchTooLarge(ValueError):
    pass


@dataclass(frozen=True)
class RunOptions:
    """``max_batch_rows`` is off by default: a cluster needs no cap. ``client_factory`` turns the
    external diagnoser on; ``alert_sinks`` get one row per run that quarantined anything."""

    rules: Rules = field(default_factory=Rules)
    max_batch_rows: int | None = None
    client_factory: ClientFactory | None = None
    max_in_flight: int = 8
    alert_sinks: Sequence[AlertSink] = ()


def _now() -> datetime:
    return datetime.now(timezone.utc)


class _RunRow:
    """The row of the runs table, rewritten at each step of the life of a run."""

    def __init__(self, store: Store, run_id: int):
        self.store, self.run_id = store, run_id
        self.attempt = store.new_attempt(run_id)
        self.values = dict(
            started_at=_now(),
            finished_at=None,
            row_count=0,
            clean_first_pass=0,
            healed=0,
            quarantined=0,
            error_types={},
            fixes_applied={},
            avg_time_to_heal_ms=None,
            status="running",
            run_id=run_id,
        )

    def save(self, **changes) -> dict:
        self.values.update(changes)
        if self.values["status"] != "running":
            self.values["finished_at"] = _now()
            self.store.show(self.run_id, self.attempt)
        self.store.write(self.frame(), "runs", self.run_id)
        return dict(self.values)

    def frame(self) -> DataFrame:
        return self.store.spark.createDataFrame([self.values], RUNS).coalesce(1)


def send_alerts(store: Store, run: DataFrame, run_id: int, sinks: Sequence[AlertSink]) -> None:
    """Write an alert row if the run quarantined anything, log it and hand it to the sinks.

    The row is written whatever becomes of its delivery; a sink cannot fail a run.
    """
    alerts = alert_rows(run).withColumn("created_at", F.current_timestamp())
    store.write(alerts.coalesce(1), "alerts", run_id)
    for alert in alerts.toLocalIterator():
        logger.warning(alert["text"])
        for sink in sinks:
            try:
                sink(alert)
            except Exception:
                logger.exception("Alert sink failed for run %s", alert["run_id"])


def run_batch(
    store: Store,
    frame: DataFrame,
    known: DataFrame,
    run_id: int,
    options: RunOptions | None = None,
    row_index: str | None = None,
) -> dict:
    """Process one batch and return its run row.

    ``frame`` is an all-string table with normalised names, ``known`` one column of known foreign keys.
    ``row_index`` names a column that holds the position of a row, if there is one.

    Schema drift is a normal end (``rejected_schema_drift``). A batch over the cap and any error end as
    ``failed``, with the number of rows as far as it can be counted, and raise. The rows of the run are seen in
    the store at its end, all at once; a failed run shows those that it had written.
    """
    return _tracked(store, lambda: frame, known, run_id, options, row_index)


def run_files(
    store: Store, path: str | list[str], known: DataFrame, run_id: int, options: RunOptions | None = None
) -> dict:
    """Process CSV files as one batch. A file that cannot be read is a failed run."""
    return _tracked(
        store, lambda: read_csv(store.spark, path, row_index="row_index"), known, run_id, options, "row_index"
    )


def _tracked(
    store: Store,
    source: Callable[[], DataFrame],
    known: DataFrame,
    run_id: int,
    options: RunOptions | None,
    row_index: str | None,
) -> dict:
    row = _RunRow(store, run_id)
    row.save()
    frame = None
    with scratch_space(store.spark):
        try:
            frame = source()
            return _process(store, frame, known, row, options or RunOptions(), row_index)
        except Exception:
            row.save(status="failed", row_count=row.values["row_count"] or _rows_of(frame))
            raise


def _rows_of(frame: DataFrame | None) -> int:
    """Rows of a batch whose run failed; 0 where not even that can be read."""
    try:
        return frame.count() if frame is not None else 0
    except Exception:
        return 0


def _process(
    store: Store, frame: DataFrame, known: DataFrame, row: _RunRow, options: RunOptions, row_index: str | None
) -> dict:
    rules, contract, run_id = options.rules, options.rules.contract, row.run_id
    reserved = (row_index,) if row_index else ()

    cap = options.max_batch_rows
    if cap is not None and frame.limit(cap + 1).count() > cap:
        row_count = frame.count()
        row.save(row_count=row_count)
        raise BatchTooLarge(f"Batch has {row_count} rows, exceeding the {cap}-row upload cap")
    try:
        check_drift(frame, contract, reserved)
    except SchemaDriftError as drift:
        logger.error("Run %s rejected: %s", run_id, drift)
        return row.save(
            status="rejected_schema_drift",
            row_count=frame.count(),
            error_types={"schema_drift": len(drift.unexpected_columns)},
        )

    if row_index is None:
        frame, row_index = with_row_index(frame, "row_index"), "row_index"
    rows = row_frame(frame, contract, run_id, F.col(row_index))
    # The contract and the key check run once; claims, clean rows and repairs read what they wrote.
    checked = settle_table(first_pass(rows, contract, known), "checked")
    existing = store.existing_keys(not_run=run_id) if contract.unique_key else None

    if contract.unique_key:
        claims = valid_rows(checked).select(
            F.col(contract.unique_key).alias("claim"), "run_id", "row_index", F.lit(False).alias("healed")
        )
        facts = claim_facts(claims, existing, across_runs=False)
        claim = F.when(F.col("error_type").isNull(), F.col(contract.unique_key))
        marked = attach_facts(checked, facts, claim)
        duplicate = F.when(F.col("error_type").isNull() & is_duplicate(), F.lit(contract.duplicate_type))
        checked = marked.withColumn("error_type", F.coalesce("error_type", duplicate)).drop(*FACTS)

    stamp = F.lit(row.values["started_at"]).cast("timestamp")
    store.write(
        typed_rows(checked, contract).withColumn("created_at", stamp), "clean", run_id, "origin=first_pass", row.attempt
    )

    # Invalid rows are repaired and written once; every other table is read off that result. They are
    # written before the clock starts, so that the time is that of the repairs.
    diagnoser = None
    if options.client_factory is not None:
        diagnoser = external_diagnoser(
            options.client_factory, contract, rules.transforms, options.max_in_flight
        )
    bad = settle_table(invalid_rows(checked), "invalid")
    started = time.perf_counter()
    repaired = settle_table(
        repair_rows(bad, contract, known, rules.transforms, rules.max_attempts, diagnoser), "repairs"
    )
    spent_ms = (time.perf_counter() - started) * 1000
    settled = settle_table(_settle_repaired(store, repaired, rules, existing, row), "settled")

    healed = clean_rows(settled, contract).drop("disposition").withColumn("created_at", stamp)
    store.write(healed, "clean", run_id, "origin=healed", row.attempt)
    store.write(quarantine_rows(settled, contract).withColumn("created_at", stamp), "quarantine", run_id, attempt=row.attempt)
    store.write(audit_rows(settled, contract).withColumn("created_at", stamp), "audit", run_id, attempt=row.attempt)

    # One aggregation over the repaired rows gives all counts; the clean rows are counted where they lie.
    n_clean = store.accepted(run_id, row.attempt).count()
    counts = run_counts(settled, rules).first()
    n_bad, n_healed = (counts["row_count"], counts["healed"]) if counts else (0, 0)
    if "heal_ms" in settled.columns:
        mean = settled.filter("disposition = 'healed'").agg(F.avg("heal_ms")).first()[0]
    else:
        mean = spent_ms / n_healed if n_healed else None
    done = row.save(
        status="completed",
        row_count=n_clean + n_bad,
        clean_first_pass=n_clean,
        healed=n_healed,
        quarantined=n_bad - n_healed,
        error_types=dict(counts["error_types"]) if counts else {},
        fixes_applied=dict(counts["fixes_applied"]) if counts else {},
        avg_time_to_heal_ms=mean,
    )
    send_alerts(store, row.frame(), run_id, options.alert_sinks)
    return done


def _settle_repaired(
    store: Store, repaired: DataFrame, rules: Rules, existing: DataFrame | None, row: _RunRow
) -> DataFrame:
    """Disposition of the repaired rows: a healed key may already be held by a row of this run."""
    contract, run_id = rules.contract, row.run_id
    if contract.unique_key is None:
        hit = repaired.withColumn("collided", F.lit(False))
    else:
        claim = F.when(F.col("healed"), F.col("final")[contract.unique_key])
        healed = repaired.select(claim.alias("claim"), "run_id", "row_index", "healed").filter(
            F.col("claim").isNotNull()
        )
        written = store.accepted(run_id, row.attempt)
        held = (
            written.select(F.col(contract.unique_key).alias("claim"), "row_index")
            .join(healed.select("claim").distinct(), "claim", "left_semi")
            .select(
                "claim", F.lit(run_id).cast("bigint").alias("run_id"), "row_index", F.lit(False).alias("healed")
            )
        )
        facts = claim_facts(
            healed.unionByName(held), existing if rules.recheck_duplicates else None, across_runs=False
        )
        looked = attach_facts(repaired, facts, claim)
        collided = F.col("healed") & is_healed_collision(rules.recheck_duplicates)
        hit = looked.withColumn("collided", collided).drop(*FACTS)
    return hit.withColumns(
        {
            "healed": F.col("healed") & ~F.col("collided"),
            "end_reason": F.when(F.col("collided"), F.lit("no_fix")).otherwise(F.col("end_reason")),
            "quarantine_type": F.when(F.col("collided"), F.lit(contract.duplicate_type)).otherwise(
                F.col("error_type")
            ),
            "disposition": F.when(F.col("healed") & ~F.col("collided"), F.lit("healed")).otherwise(
                F.lit("quarantined")
            ),
        }
    )
