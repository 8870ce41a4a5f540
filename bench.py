"""Headline queries at one scale; prints one JSON line.

    BENCH_SF_DIR   folder of the tables   (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores            (default 8)

``orders_run`` is the whole tracked run over all messy orders: check, repair, write the tables. The other
entries are single queries whose full result is computed and thrown away; ``tables_written`` is the time to
settle all runs and write their tables, which the questions after it read. The tables are copied to scratch
in several files first, because a scan cannot split the single row group they come in. A small scale is run
before, so that the figures do not contain the start of the JVM.

``scaling`` has the tracked run at other sizes (rows, seconds) and the marginal rows per second and core
between the largest two.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from mendery.contract import ORDERS
from mendery.plans import run_catalog
from mendery.plans.catalog import stored_orders
from mendery.plans.run import run_batch
from mendery.plans.sample_orders import known_customers, messy_orders
from mendery.session import local_session, scratch_path
from mendery.sources.tables import Store

QUERIES = run_catalog.QUERIES
REFERENCE_CAP = 10_000  # rows of the largest batch that the reference takes

HEADLINES = [
    "s1_csv_folder",
    "s5_value_trim",
    "s7_row_index",
    "v6_amount",
    "v9_all_errors",
    "v12_store_duplicates",
    "v15_typed_rows",
    "error_type_counts",
    "d3_fixable_field",
    "r2_reformat_date",
    "r7_bounded_loop",
    "tables_written",
    "o1_clean_store",
    "o2_quarantine_rows",
    "o5_audit_rows",
    "o7_run_counts",
    "q2_one_run",
    "q4_quarantine_page",
    "q7_totals",
    "q10_error_totals",
    "q14_audit_patterns",
    "t1_arriving_files",
]


def copied(spark, folder, files):
    """The tables that the queries read, in ``files`` files each."""
    root = scratch_path(spark, "input")
    for name in ("orders", "customer", "lineitem", "events"):
        spark.read.parquet(f"{folder}/{name}.parquet").repartition(files).write.parquet(f"{root}/{name}.parquet")
    return root


def orders_run(spark, folder, rows=None):
    store = Store(spark, scratch_path(spark, "bench"), ORDERS)
    frame = messy_orders(spark, folder).drop("run_id")
    if rows is not None:
        frame = frame.filter(f"row_index < {rows}")
    return run_batch(store, frame, known_customers(spark, folder), 1, row_index="row_index")


def timed(call):
    started = time.perf_counter()
    result = call()
    return time.perf_counter() - started, result


def compute(query, spark, folder):
    query(spark, folder).write.format("noop").mode("overwrite").save()


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    conf = {"spark.sql.shuffle.partitions": str(cpus), "spark.checkpoint.dir": tempfile.mkdtemp(prefix="mendery-bench-")}
    spark = local_session("bench", cores=cpus, **conf)
    spark.sparkContext.setLogLevel("ERROR")
    there = os.path.dirname(folder)
    data = copied(spark, folder, cpus)

    scaling = []
    small = f"{there}/sf0.001"
    if os.path.isdir(small):
        orders_run(spark, small)
        compute(QUERIES["r7_bounded_loop"], spark, small)
        for other in ("sf0.001", "sf0.01"):
            if os.path.isdir(f"{there}/{other}") and f"{there}/{other}" != folder:
                spent, run = timed(lambda: orders_run(spark, copied(spark, f"{there}/{other}", cpus)))  # noqa: B023
                scaling.append({"sf": other[2:], "rows": run["row_count"], "sec": round(spent, 3)})
    spent, run = timed(lambda: orders_run(spark, data, REFERENCE_CAP))
    scaling.append({"sf": "cap", "rows": run["row_count"], "sec": round(spent, 3)})

    seconds = {}
    seconds["orders_run"], run = timed(lambda: orders_run(spark, data))
    scaling.append({"sf": os.path.basename(folder).removeprefix("sf"), "rows": run["row_count"], "sec": round(seconds["orders_run"], 3)})
    for name in HEADLINES:
        if name == "tables_written":
            seconds[name], _ = timed(lambda: stored_orders(spark, data))
        else:
            seconds[name], _ = timed(lambda: compute(QUERIES[name], spark, data))  # noqa: B023
    by_rows = sorted(scaling, key=lambda s: s["rows"])
    a, b = by_rows[-2:]
    marginal = (b["rows"] - a["rows"]) / max(b["sec"] - a["sec"], 1e-3) / cpus
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in seconds.items()},
                "sf": os.path.basename(folder).removeprefix("sf"),
                "rows": run["row_count"],
                "rows_per_sec": round(run["row_count"] / seconds["orders_run"]),
                "cores": cpus,
                "scaling": scaling,
                "marginal_rows_per_sec_per_core": round(marginal),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
