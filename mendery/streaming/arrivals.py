"""Files that arrive over time: every micro-batch is one tracked run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mendery.plans.run import RunOptions, run_files
from mendery.sources.csv import stream_files
from mendery.sources.tables import Store


def process_arrivals(
    store: Store,
    folder: str,
    known: DataFrame,
    checkpoint: str,
    options: RunOptions | None = None,
    first_run_id: int = 1,
    max_files: int | None = None,
) -> StreamingQuery:
    """Process what has arrived in ``folder`` since the last call, then stop.

    The run id follows the batch id, and a run overwrites its own folders, so a batch that is replayed
    after a failure gives the same tables as if it had run once. Each run is deduplicated against all
    rows that other runs accepted before it. The stream only tells which files are new; they are read like
    any batch, each under its own header and in the order of files and lines. With ``max_files=1`` every
    file is a run of its own, so that a drifted file rejects nothing else.
    """
    arrivals = stream_files(store.spark, folder, max_files)

    def one_run(batch: DataFrame, batch_id: int) -> None:
        files = sorted(r["file"] for r in batch.collect())
        if files:
            run_files(store, files, known, first_run_id + batch_id, options)

    return (
        arrivals.writeStream.foreachBatch(one_run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
