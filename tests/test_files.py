"""CSV files under headers of their own, scratch folders, and keys beyond six digits."""

import duckdb
import pytest

from mendery import session
from mendery.contract import ORDERS
from mendery.plans import catalog, oracle
from mendery.plans.run import run_batch, run_files
from mendery.sources.csv import MAX_COLUMNS, TooManyColumns, read_csv, spread_ragged
from mendery.sources.tables import Store


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def rows_of(frame):
    return [tuple(r) for r in frame.collect()]


def test_every_file_has_its_own_header(spark, tmp_path):
    write(tmp_path / "a.csv", "order_id, Amount\n1,2\n")
    write(tmp_path / "b.csv", "amount,order_id,note\r\n3,4,n\r\n5,6\r\n")
    got = read_csv(spark, str(tmp_path), row_index="i")
    assert got.columns == ["order_id", "amount", "note", "i"]
    assert sorted(rows_of(got), key=lambda r: r[3]) == [("1", "2", None, 0), ("4", "3", "n", 1), ("6", "5", "", 2)]


def test_positions_follow_paths_and_lines(spark, tmp_path):
    write(tmp_path / "1.csv", "k\nx0\n")
    write(tmp_path / "2.csv", "k\n" + "".join(f"x{i}\n" for i in range(1, 2000)))
    got = read_csv(spark, [str(tmp_path / "2.csv"), str(tmp_path / "1.csv")], row_index="i")
    assert {r.k: r.i for r in got.collect()} == {f"x{i}": i for i in range(2000)}


def test_blocks_of_one_file(spark, tmp_path):
    """A file that is split into many blocks, with empty lines and lines of blanks in between."""
    lines = ["k,v"]
    for i in range(3000):
        lines += [f"{i},{'y' * (i % 50)}"] + [""] * (i % 3 == 0) + ["   "] * (i % 500 == 0)
    write(tmp_path / "f.csv", "\n".join(lines) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        got = read_csv(spark, str(tmp_path / "f.csv"), row_index="i")
        assert got.rdd.getNumPartitions() > 5
        rows = sorted(rows_of(got), key=lambda r: r[2])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = [line for line in lines[1:] if line != ""]
    assert [r[2] for r in rows] == list(range(len(want)))
    assert [(r[0], r[1]) for r in rows] == [tuple(x.strip() for x in (w.split(",") + [""])[:2]) for w in want]


def test_quoted_line_breaks_are_found(spark, tmp_path):
    write(tmp_path / "a.csv", 'k,note\n1,"two\nlines, and ""more"""\n2,x\n')
    write(tmp_path / "b.csv", "note,k\ny,3\n")
    got = read_csv(spark, str(tmp_path), row_index="i")
    assert sorted(rows_of(got), key=lambda r: r[2]) == [("1", 'two\nlines, and "more"', 0), ("2", "x", 1), ("3", "y", 2)]


def test_files_without_rows(spark, tmp_path):
    write(tmp_path / "a.csv", "odd,k\n")
    write(tmp_path / "b.csv", "")
    assert read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).columns == ["odd", "k"]
    assert read_csv(spark, str(tmp_path / "a.csv")).count() == 0
    assert read_csv(spark, str(tmp_path / "b.csv"), row_index="i").columns == ["i"]
    write(tmp_path / "c.csv", "k\n1\n")
    assert read_csv(spark, str(tmp_path)).columns == ["k"]


def test_one_drifted_file_rejects_the_batch(spark, tmp_path, base, known):
    header, line = ",".join(base), ",".join(base.values())
    write(tmp_path / "a.csv", f"{header}\n{line}\n")
    write(tmp_path / "b.csv", f"{','.join(reversed(base))},Internal_Notes\n{','.join(reversed(base.values()))},x\n")
    store = Store(spark, str(tmp_path / "store"), ORDERS)
    done = run_files(store, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], known, 1)
    assert (done["status"], done["row_count"], done["error_types"]) == ("rejected_schema_drift", 2, {"schema_drift": 1})
    done = run_files(store, str(tmp_path / "a.csv"), known, 2)
    assert (done["status"], done["clean_first_pass"]) == ("completed", 1)


def test_a_file_that_cannot_be_read_is_a_failed_run(spark, tmp_path, known):
    store = Store(spark, str(tmp_path / "store"), ORDERS)
    with pytest.raises(Exception, match="(?i)path"):
        run_files(store, str(tmp_path / "none.csv"), known, 7)
    (row,) = store.runs().collect()
    assert (row.run_id, row.status, row.row_count) == (7, "failed", 0) and row.finished_at


def test_a_run_removes_its_scratch_and_nothing_else(spark, tmp_path, make_rows, known):
    from pathlib import Path

    root = Path(session.shared_dir(spark).removeprefix("file:"))
    kept = session.scratch_path(spark, "kept")
    spark.range(1).write.parquet(kept)
    before = {p.name for p in root.iterdir()}
    store = Store(spark, str(tmp_path / "store"), ORDERS)
    run_batch(store, make_rows({}, {"amount": "$5.00"}).drop("run_id"), known, 1, row_index="row_index")
    assert {p.name for p in root.iterdir()} == before
    assert spark.read.parquet(kept).count() == 1


def test_existing_keys_are_looked_up_from_the_batch(spark, tmp_path, make_rows, known):
    """The store's keys are neither sorted nor shuffled for a small batch."""
    from mendery.operators.checks import held_keys

    store = Store(spark, str(tmp_path / "store"), ORDERS)
    for run in range(1, 6):
        run_batch(store, make_rows(*({"order_id": f"ORD-{run}{i:05d}"} for i in range(5))).drop("run_id"), known, run, row_index="row_index")
    claims = session.settle_table(spark.createDataFrame([("ORD-100001",), ("ORD-999999",)], "claim string"), "claims")
    held = held_keys(store.existing_keys(not_run=9), claims)
    assert rows_of(held) == [("ORD-100001",)]
    text = held._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def _rows_scanned(frame):
    """Rows that the scans below a frame gave out, after running it."""
    rows = frame.collect()
    plan, seen = [frame._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
        if "FileScan" in node.toString().splitlines()[0] and children.size() == 0:
            seen += node.metrics().apply("numOutputRows").value()
    return sorted(map(tuple, rows)), seen


def test_what_is_read_of_the_store_follows_the_batch(spark, tmp_path, make_rows, monkeypatch):
    """Ten times the history, with ids that rise: no more rows are read for the same claims."""
    from mendery.operators import checks

    monkeypatch.setattr(checks, "below_broadcast_limit", lambda frame: False)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        seen = {}
        for runs in (4, 40):
            store = Store(spark, str(tmp_path / f"store-{runs}"), ORDERS)
            ids = [{"order_id": f"ORD-{run:04d}{i:04d}", "run_id": run} for run in range(runs) for i in range(20)]
            rows = checks.typed_rows(checks.check_contract(make_rows(*ids), ORDERS), ORDERS)
            rows.coalesce(1).write.partitionBy("run_id").parquet(store.path("clean"))
            wanted = ["ORD-00010003", "ORD-00010019", "ORD-00030001", "ORD-90000000", None]
            claims = session.settle_table(spark.createDataFrame([(c,) for c in wanted], "claim string"), "claims")
            existing = store.existing_keys()
            assert rows_of(existing.groupBy().count()) == [(runs * 20,)]
            held, n = _rows_scanned(checks.held_keys(existing, claims))
            assert held == [("ORD-00010003",), ("ORD-00010019",), ("ORD-00030001",)]
            seen[runs] = n
        assert seen[4] == seen[40] <= 2 * 20 + len(wanted)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_claim_ranges(spark):
    from mendery.operators.checks import claim_ranges

    frame = lambda values: spark.createDataFrame([(v,) for v in values], "claim string")
    many = [f"ORD-{i:06d}" for i in range(5000, 7000)] + ["A", "ORD-000001", "é"]
    ranges = claim_ranges(frame([*many, *many, None]), most=16)
    assert len(ranges) <= 16 and all(any(low <= v <= high for low, high in ranges) for v in many)
    assert {("A", "A"), ("ORD-000001", "ORD-000001"), ("é", "é")} <= set(ranges)
    assert claim_ranges(frame(["a", "b", "c"]), most=1) == [("a", "c")]
    assert claim_ranges(frame([])) == claim_ranges(frame([None])) == []
    assert claim_ranges(frame(["x" * 40 + str(i) for i in range(10)]), most=8) == [("x" * 40 + "0", "x" * 40 + "9")]


def test_totals_are_kept_up_to_date(spark, tmp_path):
    """After new, repeated and failed runs, merges, and merges that stopped, they equal those over all runs."""
    from datetime import datetime, timedelta

    from mendery.plans import analytics
    from mendery.plans.running import map_totals_of, totals_of
    from mendery.sources.tables import RUNS

    store = Store(spark, str(tmp_path / "store"), ORDERS)
    clock = iter(datetime(2026, 1, 1) + timedelta(minutes=i) for i in range(100))

    def same():
        sums, runs = store.run_totals(), store.runs()
        assert totals_of(sums).collect() == analytics.totals(runs).collect()
        for column in ("error_types", "fixes_applied"):
            assert sorted(rows_of(map_totals_of(sums, column))) == sorted(rows_of(analytics.map_totals(runs, column)))
        return totals_of(sums).first()["total_rows_processed"]

    def run(run_id, n, errors, status="completed", fixes=None):
        row = (next(clock), next(clock), n, n - len(errors), 0, len(errors), errors, fixes, None, status, run_id)
        store.write(spark.createDataFrame([row], RUNS).coalesce(1), "runs", run_id)

    assert same() == 0
    run(1, 10, {"invalid_amount": 2, "invalid_status": 1}, fixes={"coerce_amount": 2})
    run(2, 5, {"invalid_status": 1}, fixes={})
    run(4, 7, {}, status="running")
    assert same() == 15 and store.compact_runs() == 2 and same() == 15
    run(2, 8, {"invalid_foreign_key": 3})  # repeated after it was merged
    run(1, 10, {"invalid_amount": 9}, status="failed")  # and one that fails now
    assert same() == 8
    # a merge that stops before its totals are written is made up for by the next one
    path_of = store.path
    store.path = lambda table, *rest: str(tmp_path / "lost") if table == "totals" else path_of(table, *rest)
    store.compact_runs()
    store.path = path_of
    run(3, 1, {})
    assert store.compact_runs() == 1 and same() == 9
    run(4, 7, {"invalid_amount": 1})
    assert same() == 16


def test_run_rows_are_compacted(spark, tmp_path, make_rows, known):
    store = Store(spark, str(tmp_path / "store"), ORDERS)
    for run in (1, 2):
        run_batch(store, make_rows({"order_id": f"ORD-{run:06d}"}).drop("run_id"), known, run, row_index="row_index")
    before = sorted(map(str, store.runs().select("run_id", "status", "row_count", "error_types").collect()))
    assert store.compact_runs() == 2 and store.compact_runs() == 0
    assert sorted(map(str, store.runs().select("run_id", "status", "row_count", "error_types").collect())) == before
    run_batch(store, make_rows({}, {}).drop("run_id"), known, 2, row_index="row_index")
    assert sorted((r.run_id, r.row_count) for r in store.runs().collect()) == [(1, 1), (2, 2)]
    assert [r.row_count for r in store.runs().filter("run_id = 1").collect()] == [1]


class _Context:
    def __init__(self, master):
        self.master = master

    def getCheckpointDir(self):  # noqa: N802
        return None


class _Session:
    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default

    def __init__(self, master):
        self.sparkContext = _Context(master)


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "k8s://h", "local-cluster[2,1,1024]"])
def test_clusters_need_a_shared_folder(master):
    with pytest.raises(session.NoSharedFolder):
        session.shared_dir(_Session(master))


def test_free_form_keys_are_refused(spark):
    assert spread_ragged(spark.createDataFrame([({"a": "1"},), ({"b": "2"},)], "raw map<string,string>")).columns == ["a", "b"]
    many = spark.range(MAX_COLUMNS + 1).selectExpr("map(cast(id AS string), 'x') AS raw")
    with pytest.raises(TooManyColumns):
        spread_ragged(many)


@pytest.fixture(scope="module")
def wide_keys(spark, tmp_path_factory):
    """Orders, line items and customers with keys around one million."""
    folder = str(tmp_path_factory.mktemp("wide"))
    keys = spark.range(999_960, 1_000_060)
    orders = keys.selectExpr(
        "id AS o_orderkey", "id + 7 AS o_custkey", "'F' AS o_orderstatus", "cast(100.5 AS double) AS o_totalprice",
        "timestamp'1996-03-04 00:00:00' AS o_orderdate",
    )
    orders.coalesce(1).write.parquet(f"{folder}/orders.parquet")
    keys.selectExpr("id AS l_orderkey").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    keys.selectExpr("id + 7 AS c_custkey", "concat('c', id) AS c_name").coalesce(1).write.parquet(f"{folder}/customer.parquet")
    return folder


@pytest.mark.parametrize("name", ["s8_known_customers", "s9_existing_orders", "o1_clean_store"])
def test_keys_beyond_six_digits(spark, wide_keys, name):
    duck = duckdb.connect()
    for t in ("orders", "lineitem", "customer"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{wide_keys}/{t}.parquet/*.parquet'")
    frame = catalog.QUERIES[name](spark, wide_keys)
    cursor = duck.execute(catalog.ORACLE[name])
    order = [[c[0] for c in cursor.description].index(c) for c in frame.columns]
    want = [tuple(row[i] for i in order) for row in cursor.fetchall()]
    got = rows_of(frame)
    assert len(got) > 30 and sorted(map(str, got)) == sorted(map(str, want))
    assert oracle.FIELDS == ORDERS.columns


@pytest.fixture
def small_blocks(spark):
    """Files are split every few bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in zip(names, ("97", "10", "1"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def untidy_file(rng, n):
    """CSV text with line breaks, quotes and delimiters in fields, empty lines, and stray quotes."""
    fields = ["", "x", " y ", 'say ""hi""', "a,b", "two\nlines", "three\n\n\nlines", "\n", 'end""', "long " * 30, "cr\r\nlf", 'q"",""\n,""q']
    lines = ['id,"no\nte",z']
    for i in range(n):
        lines.append(",".join([str(i), *[f'"{rng.choice(fields)}"' if rng.random() < 0.6 else rng.choice(["", "p", '5" pipe', " q "]) for _ in range(2)]]))
        lines += [""] * rng.choice([0, 0, 0, 1, 2])
    return rng.choice(["\n", "\r\n"]).join(lines) + rng.choice(["", "\n"])


@pytest.mark.parametrize("lines_stay", [True, False])
def test_records_of_split_files(spark, tmp_path, small_blocks, monkeypatch, lines_stay):
    """Quoted line breaks wherever blocks are cut: the same records as the standard reader gives."""
    import csv
    import io
    import random

    from mendery.sources import records

    monkeypatch.setattr(records, "BROADCAST_BLOCKS", 100_000 if lines_stay else 0)
    rng = random.Random(7)
    want = []
    for i in range(4):
        text = untidy_file(rng, 40)
        write(tmp_path / f"{i}.csv", text)
        rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
        assert rows[0] == ["id", "no\nte", "z"]
        want += [tuple(v.strip() for v in r) for r in rows[1:]]
    write(tmp_path / "9.csv", "id,z\nlast,one\n")
    got = read_csv(spark, str(tmp_path), row_index="i")
    assert got.columns == ["id", "no\nte", "z", "i"]
    rows = sorted(rows_of(got), key=lambda r: r[3])
    assert [r[3] for r in rows] == list(range(len(want) + 1))
    assert [r[:3] for r in rows[:-1]] == want and rows[-1] == ("last", None, "one", len(want))


def test_many_torn_files_make_one_plan(spark, tmp_path):
    """Jobs and plan do not grow with the number of files that have quoted line breaks."""
    counts = []
    for n in (3, 150):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            write(folder / f"{i:04}.csv", f'k,note\n{i},"a\nb"\n')
        frame = read_csv(spark, str(folder), row_index="i")
        counts.append(len(frame._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        assert {(r.k, r.note, r.i) for r in frame.collect()} == {(str(i), "a\nb", i) for i in range(n)}
    assert counts[0] == counts[1]


def test_open_quotes_and_empty_lines(spark, tmp_path):
    write(tmp_path / "a.csv", '\n\nk,v\n\n1,"x\n\ny"\n\n\n2,"never closed\nmore\n')
    write(tmp_path / "b.csv", "k,v\n" + "\n" * 5000 + "3,z\n")
    got = sorted(rows_of(read_csv(spark, str(tmp_path), row_index="i")), key=lambda r: r[2])
    assert [(r[0], r[2]) for r in got] == [("1", 0), ("2", 1), ("3", 2)]
    assert got[0][1] == "x\n\ny" and got[1][1].strip('"').startswith("never closed\nmore")
