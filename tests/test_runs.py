"""Tracked runs, stores, CSV, streams, analytics, faults."""

import logging

import pytest
from pyspark.sql import functions as F

from mendery.contract import ORDERS
from mendery.operators import checks, faults
from mendery.operators.faults import MOJIBAKE
from mendery.plans import analytics, pages
from mendery.plans.outcomes import alert_rows
from mendery.plans.run import BatchTooLarge, RunOptions, run_batch
from mendery.session import scratch_path
from mendery.sources.csv import csv_layout, read_csv, spread_ragged, write_csv
from mendery.sources.tables import Store
from mendery.streaming.arrivals import process_arrivals


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), ORDERS)


def batch(make_rows, *changes):
    return make_rows(*changes).drop("run_id")


def go(store, frame, known, run_id=1, **options):
    return run_batch(store, frame, known, run_id, RunOptions(**options), row_index="row_index")


def test_run_writes_every_row_once(store, make_rows, known):
    alerts = []
    frame = batch(make_rows, {}, {}, {"amount": "$5"}, {"status": ""}, {"order_id": "ORD-000001"}, {"order_id": "ORD-000002" + MOJIBAKE})
    done = go(store, frame, known, alert_sinks=[alerts.append])
    assert done["status"] == "completed" and done["finished_at"] is not None
    assert (done["row_count"], done["clean_first_pass"], done["healed"], done["quarantined"]) == (6, 2, 1, 3)
    assert done["error_types"] == {"invalid_amount": 1, "invalid_status": 1, "duplicate_order_id": 1, "invalid_order_id": 1}
    assert done["fixes_applied"] == {"coerce_amount": 1, "fix_encoding": 1}
    assert done["avg_time_to_heal_ms"] > 0
    clean = store.clean().collect()
    assert sorted((r["row_index"], r["origin"]) for r in clean) == [(0, "first_pass"), (1, "first_pass"), (2, "healed")]
    assert dict(store.clean().dtypes)["amount"] == "decimal(12,2)"
    kept = {r["row_index"]: r["error_type"] for r in store.quarantine().collect()}
    assert kept == {3: "invalid_status", 4: "duplicate_order_id", 5: "duplicate_order_id"}
    assert store.audit().count() == 4
    assert [a["quarantined_count"] for a in alerts] == [3]


class Watched(Store):
    """Notes after each write what a reader sees of the run, and is killed after a given number of them."""

    def __init__(self, *args, writes=99):
        super().__init__(*args)
        self.writes, self.seen = writes, []

    def write(self, frame, table, run_id, part=None, attempt=None):
        super().write(frame, table, run_id, part, attempt)
        if attempt is not None:
            self.seen.append(contents(Store(self.spark, self.root, self.contract)))
            self.writes -= 1
            if not self.writes:
                raise KeyboardInterrupt


def contents(store):
    rows = [("clean", r.run_id, r.row_index) for r in store.clean().collect()]
    rows += [("quarantine", r.run_id, r.row_index) for r in store.quarantine().collect()]
    return sorted(rows + [("audit", r.run_id, r.row_index) for r in store.audit().collect()])


def test_rows_of_a_run_are_seen_at_its_end(spark, store, make_rows, known):
    frame = batch(make_rows, {}, {"amount": "$5"}, {"status": ""})
    first = Watched(spark, store.root, ORDERS)
    go(first, frame, known)
    assert first.seen == [[]] * 4
    whole = contents(store)
    assert [x[:1] + x[2:] for x in whole] == [("audit", 1), ("audit", 2), ("clean", 0), ("clean", 1), ("quarantine", 2)]

    # the run is repeated with other rows and killed: the rows of before stand, whole, also for other runs
    other = batch(make_rows, {"status": ""}, {})
    for writes in (1, 3):
        killed = Watched(spark, store.root, ORDERS, writes=writes)
        with pytest.raises(KeyboardInterrupt):
            go(killed, other, known)
        assert killed.seen == [whole] * writes and contents(store) == whole
        assert store.quarantine_of([1]).count() == 1 and store.existing_keys(not_run=2).count() == 2
    # repeated once more it is replaced as a whole, and files of killed attempts are gone
    again = Watched(spark, store.root, ORDERS)
    done = go(again, other, known)
    assert again.seen == [whole] * 4 and done["row_count"] == 2
    assert [x for x in contents(store) if x[0] != "audit"] == [("clean", 1, 1), ("quarantine", 1, 0)]
    assert spark.read.parquet(store.path("clean", 1)).select("__attempt").distinct().count() == 2
    # markers that were brought together count like others, also against those of later attempts
    assert store.compact_runs() == 1 and contents(store) == contents(again) != whole
    go(store, other, known)
    assert [x for x in contents(store) if x[0] != "audit"] == [("clean", 1, 1), ("quarantine", 1, 0)]
    assert spark.read.parquet(store.path("clean", 1)).select("__attempt").distinct().count() == 2


def test_a_failed_run_shows_what_it_had_written(spark, store, make_rows, known, monkeypatch):
    def fail(*args):
        raise ValueError("no repairs today")

    monkeypatch.setattr("mendery.plans.run.repair_rows", fail)
    with pytest.raises(ValueError, match="no repairs"):
        go(store, batch(make_rows, {}, {"amount": "$5"}), known)
    assert contents(store) == [("clean", 1, 0)]
    assert [r["status"] for r in store.runs().collect()] == ["failed"]


def test_all_clean_run(store, make_rows, known):
    done = go(store, batch(make_rows, {}, {}), known)
    assert (done["clean_first_pass"], done["healed"], done["quarantined"]) == (2, 0, 0)
    assert done["avg_time_to_heal_ms"] is None and done["error_types"] == {}


def test_second_upload_is_all_duplicates_and_a_repeat_changes_nothing(store, make_rows, known):
    frame = batch(make_rows, {}, {}, {}, {}, {})
    go(store, frame, known, 1)
    again = go(store, frame, known, 2)
    assert (again["clean_first_pass"], again["quarantined"]) == (0, 5)
    assert again["error_types"] == {"duplicate_order_id": 5}
    repeated = go(store, frame, known, 1)
    assert repeated["clean_first_pass"] == 5 and store.clean().count() == 5 and store.runs().count() == 2


def test_drift_rejects_the_batch(store, make_rows, known):
    frame = faults.add_drift(batch(make_rows, {}, {}))
    done = go(store, frame, known)
    assert done["status"] == "rejected_schema_drift" and done["error_types"] == {"schema_drift": 1}
    assert done["row_count"] == 2 and store.clean().isEmpty() and store.quarantine().isEmpty()


def test_row_cap(store, make_rows, known):
    with pytest.raises(BatchTooLarge, match="Batch has 5 rows, exceeding the 3-row upload cap"):
        go(store, batch(make_rows, {}, {}, {}, {}, {}), known, max_batch_rows=3)
    (row,) = store.runs().collect()
    assert row["status"] == "failed" and row["row_count"] == 5 and row["finished_at"] is not None


def test_a_crash_is_recorded(store, make_rows, known, monkeypatch):
    def crash(*args, **kwargs):
        raise RuntimeError("boom")

    monkeypatch.setattr("mendery.plans.run.repair_rows", crash)
    with pytest.raises(RuntimeError):
        go(store, batch(make_rows, {"amount": "$5"}), known)
    assert [r["status"] for r in store.runs().collect()] == ["failed"]


def test_alert_sink_failure_does_not_fail_the_run(store, make_rows, known, caplog):
    def sink(row):
        raise OSError("unreachable")

    with caplog.at_level(logging.WARNING):
        done = go(store, batch(make_rows, {"status": ""}), known, alert_sinks=[sink])
    assert done["status"] == "completed"
    assert "Run 1 quarantined 1 row(s). Error types: {invalid_status: 1}" in caplog.text
    assert alert_rows(store.runs()).count() == 1


def test_external_client_in_a_run(store, make_rows, known):
    def factory():
        return lambda system, user: "no answer"

    done = go(store, batch(make_rows, {}, {"amount": "$5"}, {"order_id": "ORD-000001"}), known, client_factory=factory)
    assert (done["clean_first_pass"], done["healed"], done["quarantined"]) == (1, 1, 1)
    assert done["avg_time_to_heal_ms"] >= 0


def test_resolve(store, make_rows, known):
    go(store, batch(make_rows, *[{"status": ""}] * 5), known)
    assert store.resolve(1, 99).isEmpty()
    (row,) = store.resolve(1, 3).collect()
    assert row["resolved"] and row["original_data"]["status"] == ""
    assert analytics.tab_counts(store.quarantine()).first().asDict() == {"unresolved": 4, "resolved": 1, "all_rows": 5}


# -------------------------------------------------------------------------------------- CSV


def test_csv_details(spark, tmp_path, base):
    text = (
        " Order_ID ,Customer_ID,STATUS,note\n"
        ' ORD-000001 ,"CUST-0001 ",pending,"a ""quoted"" word"\n'
        'ORD-000002,CUST-0002,,"two\nlines",extra,more\n'
        'ORD-000003,CUST-0003,""\n'
    )
    path = tmp_path / "in.csv"
    path.write_text(text, encoding="utf-8")
    rows = read_csv(spark, str(path)).collect()
    assert rows[0].asDict() == {"order_id": "ORD-000001", "customer_id": "CUST-0001", "status": "pending", "note": 'a "quoted" word'}
    assert rows[1]["note"] == "two\nlines" and rows[1]["status"] == ""
    assert rows[2]["status"] == "" and rows[2]["note"] == ""


def test_csv_header_collision_and_header_only(spark, tmp_path, store, known):
    (tmp_path / "c.csv").write_text("a,A ,b\n1,2,3\n", encoding="utf-8")
    assert [r.asDict() for r in read_csv(spark, str(tmp_path / "c.csv")).collect()] == [{"a": "2", "b": "3"}]
    (tmp_path / "h.csv").write_text("order_id,odd_column\n", encoding="utf-8")
    done = run_batch(store, read_csv(spark, str(tmp_path / "h.csv")), known, 1)
    assert done["status"] == "completed" and done["row_count"] == 0


def test_csv_run_numbers_rows_in_file_order(spark, tmp_path, store, known):
    lines = ["order_id,customer_id,order_date,amount,currency,status"]
    lines += [f",CUST-0001,2026-01-01,{i}.00,USD,pending" for i in range(1, 6)]
    (tmp_path / "f.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    run_batch(store, read_csv(spark, str(tmp_path / "f.csv")), known, 1)
    found = {r["row_identifier"]: r["row_index"] for r in store.audit().collect()}
    assert found == {f"row-{i}": i for i in range(5)}
    amounts = {r["row_index"]: r["original_data"]["amount"] for r in store.quarantine().collect()}
    assert amounts == {i: f"{i + 1}.00" for i in range(5)}


def test_csv_export(spark, tmp_path):
    left = spark.createDataFrame([("1", "x,y")], "b string, a string")
    right = spark.createDataFrame([("2", None)], "b string, c string")
    assert csv_layout(left, right).columns == ["a", "b", "c"]
    write_csv(str(tmp_path / "out"), left, right)
    lines = {line for p in (tmp_path / "out").glob("*.csv") for line in p.read_text().splitlines()}
    assert lines == {",2,", '"x,y",1,', "a,b,c"}
    ragged = spark.createDataFrame([({"z": "1"},), ({"a": "2"},)], "raw map<string,string>")
    assert spread_ragged(ragged).columns == ["a", "z"]


# ----------------------------------------------------------------------------------- streams


def test_arriving_files(spark, tmp_path, store, make_rows, known):
    landing, check = str(tmp_path / "landing"), str(tmp_path / "check")
    rows = batch(make_rows, {}, {}, {}, {"amount": "$5"}, {"status": ""}).drop("row_index")
    write_csv(landing, rows.coalesce(1))
    process_arrivals(store, landing, known, check).awaitTermination()
    write_csv(landing, rows.coalesce(1), mode="append")
    process_arrivals(store, landing, known, check).awaitTermination()
    first, second = store.runs().orderBy("run_id").collect()
    assert (first["row_count"], first["clean_first_pass"], first["healed"], first["quarantined"]) == (5, 3, 1, 1)
    assert (second["row_count"], second["clean_first_pass"], second["healed"], second["quarantined"]) == (5, 0, 1, 4)
    # a batch that is replayed replaces its own rows
    before = sorted(map(tuple, store.clean().drop("created_at").collect()))
    run_batch(store, rows, known, 1)
    assert sorted(map(tuple, store.clean().drop("created_at").collect())) == before


# --------------------------------------------------------------------------------- analytics


def runs_frame(spark, rows):
    schema = (
        "run_id bigint, status string, row_count bigint, clean_first_pass bigint, healed bigint, quarantined bigint, "
        "error_types map<string,bigint>, fixes_applied map<string,bigint>, started_at timestamp"
    )
    frame = spark.createDataFrame([(*r, None) for r in rows], schema)
    return frame.withColumn("started_at", F.timestamp_seconds(F.lit(1767225600) + F.col("run_id") * 60))


def test_stats(spark):
    runs = runs_frame(
        spark,
        [
            (1, "completed", 10, 10, 0, 0, {}, {}),
            (2, "completed", 5, 0, 0, 5, {"invalid_foreign_key": 5}, {}),
            (3, "failed", 7, 1, 1, 1, {"invalid_amount": 9}, {"coerce_amount": 9}),
        ],
    )
    total = analytics.totals(runs).first()
    assert (total["total_runs"], total["total_rows_processed"], total["total_quarantined"]) == (2, 15, 5)
    assert total["overall_heal_rate"] == 10 / 15 and total["auto_heal_rate"] == 0.0
    assert [tuple(r) for r in analytics.map_totals(runs, "error_types").collect()] == [("invalid_foreign_key", 5)]
    assert [r["started_at"] for r in analytics.heal_rate_over_time(runs).collect()] == ["2026-01-01T00:01:00", "2026-01-01T00:02:00"]
    empty = analytics.totals(runs.limit(0)).first()
    assert empty["total_rows_processed"] == 0 and empty["overall_heal_rate"] == 0.0 and empty["auto_heal_rate"] == 0.0


def test_pages(spark):
    runs = runs_frame(spark, [(i, "completed", 1, 1, 0, 0, {}, {}) for i in range(1, 6)])
    assert [r["run_id"] for r in analytics.runs_page(runs, 2, 0).collect()] == [5, 4]
    assert [r["run_id"] for r in analytics.runs_page(runs, 2, 2).collect()] == [3, 2]
    assert analytics.runs_total(runs).first()[0] == 5
    for limit, offset in ((0, 0), (501, 0), (1, -1)):
        with pytest.raises(ValueError):
            analytics.runs_page(runs, limit, offset)


def test_pages_by_continuation(spark, tmp_path, monkeypatch):
    """All pages together are the whole list in the order of pages by offset; a late page reads as little as an early one."""
    store = Store(spark, str(tmp_path / "store"), ORDERS)
    counts = [3, 0, 40, 1, 7, 0, 0, 25, 2, 11, 5, 6, 30, 4]
    statuses = {5: "failed", 6: "rejected_schema_drift"}
    schema = "run_id bigint, row_index bigint, error_type string, attempt_count int, resolved boolean, created_at timestamp"
    for run_id, n in enumerate(counts):
        runs = runs_frame(spark, [(run_id, statuses.get(run_id, "completed"), n, 0, 0, n if run_id != 5 else 0, {}, {})])
        store.write(runs.coalesce(1), "runs", run_id)
        if n or run_id == 5:
            rows = [(run_id, i, "invalid_amount", 1, False, None) for i in range(n or 2)]
            store.write(spark.createDataFrame(rows, schema), "quarantine", run_id)
    spark.range(134).selectExpr("id % 14 AS run_id", "id * 3 % 40 AS row_index", "now() AS resolved_at").write.parquet(store.path("resolutions"))
    asked, read = [], Store.quarantine_of
    monkeypatch.setattr(Store, "quarantine_of", lambda self, ids: asked.append(ids) or read(self, ids))
    whole = store.quarantine()
    for kept in ({}, {"resolved": False}, {"run_id": 2}, {"run_id": 5}, {"run_id": 99}):
        want = [(r["run_id"], r["row_index"], r["resolved"]) for r in analytics.quarantine_page(whole.drop("created_at"), **kept, limit=500).collect()]
        got, mark, reads = [], None, []
        while True:
            asked.clear()
            page = pages.seek_quarantine(store, **kept, limit=29, after=mark)
            rows = [(r["run_id"], r["row_index"], r["resolved"]) for r in page.collect()]
            reads.append(sum(map(len, asked)))
            if not rows:
                break
            got, mark = got + rows, pages.mark_of(page)
        assert got == want and max(reads) <= 12
    assert pages.seek_quarantine(store, after=pages.Mark(77, 1)).collect() == []
    assert pages.mark_of(page) is None


def test_breakdown_has_eight_bars(spark):
    totals = spark.createDataFrame([(f"kind_{i}", i // 2) for i in range(10)], "key string, total bigint")
    bars = analytics.breakdown(totals).collect()
    assert len(bars) == 8 and [b["key"] for b in bars[:3]] == ["kind_8", "kind_9", "kind_6"]


# ------------------------------------------------------------------------------------ faults


def test_inject(spark, make_rows, known):
    rows = make_rows(*[{} for _ in range(300)])
    for mode, kinds in {
        "type_mismatch": {"invalid_amount"},
        "date_format_swap": {"invalid_order_date"},
        "encoding_issue": {"invalid_order_id"},
        "invalid_foreign_key": {"invalid_foreign_key"},
        "null_required_field": {f"invalid_{c}" for c in ORDERS.columns},
    }.items():
        bad = faults.inject(rows, ORDERS, "order_id", 1.0, mode, seed=3)
        judged = checks.first_pass(bad, ORDERS, known)
        assert {r["error_type"] for r in judged.select("error_type").distinct().collect()} == kinds
        assert faults.DRIFT_COLUMN not in bad.columns
    drifted = faults.inject(rows, ORDERS, "order_id", 1.0, "schema_drift")
    assert drifted.filter(F.col(faults.DRIFT_COLUMN) == faults.DRIFT_TEXT).count() == 300


def test_inject_is_reproducible(make_rows):
    rows = make_rows(*[{} for _ in range(400)])
    one = faults.inject(rows, ORDERS, "order_id", 0.3, seed=7)
    two = faults.inject(rows.repartition(5), ORDERS, "order_id", 0.3, seed=7)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    share = one.filter("injected_mode IS NOT NULL").count() / 400
    assert 0.2 < share < 0.4
    assert faults.inject(rows, ORDERS, "order_id", 0.0).filter("injected_mode IS NOT NULL").isEmpty()
    for rate in (-0.1, 1.1):
        with pytest.raises(ValueError):
            faults.inject(rows, ORDERS, "order_id", rate)


def test_scratch_paths_differ(spark):
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
