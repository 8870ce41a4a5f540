"""Validation: contract, keys, duplicates, drift, row positions, skew."""

import pytest
from pyspark.sql import functions as F

from mendery.contract import ORDERS, Contract, Field, OneOf, Pattern, PositiveDecimal
from mendery.operators import checks, lookup
from mendery.operators.lookup import known_flag, keyed_lookup
from mendery.operators.row_index import with_row_index
from mendery.sources.rows import normalise_columns, ragged_row_frame


def types(frame):
    return [r["error_type"] for r in frame.orderBy("run_id", "row_index").select("error_type").collect()]


REJECTED = {
    "order_id": (None, " ", "ORD-", "ORD-7", "ord-1234567", "ORD-12 4567", "XORD-1234567"),
    "customer_id": (None, "CUST-", "cust-0007", "7-CUST", "0007"),
    "order_date": (None, "soon", "2026-13-01", "2026-02-30", "20260101x"),
    "amount": (None, "0.00", "-0.01", "1.005", "1,5", "five", "--5"),
    "currency": (None, "Usd", "US", "USDD", "dollar"),
    "status": (None, "PENDING", "lost", "pending,"),
}


@pytest.mark.parametrize("field", REJECTED)
def test_each_rule_rejects(make_rows, field):
    rows = make_rows(*({field: value} for value in REJECTED[field]))
    assert types(checks.check_contract(rows, ORDERS)) == [f"invalid_{field}"] * len(REJECTED[field])


def test_all_errors_in_field_order(make_rows):
    rows = make_rows({"status": None, "amount": "x", "order_id": "bad"}, {})
    got = checks.with_errors(checks.check_contract(rows, ORDERS), ORDERS).orderBy("row_index").collect()
    assert [tuple(e) for e in got[0]["errors"]] == [
        ("order_id", "Value error, order_id must match ^ORD-[A-Za-z0-9]{6,}$", "value_error"),
        ("amount", "Input should be a valid decimal", "decimal_parsing"),
        ("status", "Field required", "missing"),
    ]
    assert got[0]["error_type"] == "invalid_order_id" and got[1]["errors"] == []


@pytest.mark.parametrize("limit", ["10485760", "-1"])
def test_foreign_key_small_and_large_reference(spark, make_rows, known, tmp_path, limit):
    """The same answer whether the reference is broadcast or reduced to unknown keys first."""
    known.write.parquet(str(tmp_path / "known"))
    known = spark.read.parquet(str(tmp_path / "known"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        rows = make_rows({}, {"customer_id": "CUST-9999"}, {"customer_id": "nope"}, {"customer_id": None})
        checked = checks.first_pass(rows, ORDERS, known)
        assert types(checked) == [None, "invalid_foreign_key", "invalid_customer_id", "invalid_customer_id"]
        assert [r["key_known"] for r in checked.orderBy("row_index").collect()] == [True, False, False, False]
        assert checks.unknown_keys(checks.check_contract(rows, ORDERS), ORDERS, known).count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_size_check(spark, known, tmp_path):
    """Files have a size; rows handed over by the driver count as unbounded."""
    known.write.parquet(str(tmp_path / "known"))
    assert lookup.below_broadcast_limit(spark.read.parquet(str(tmp_path / "known")).distinct())
    assert not lookup.below_broadcast_limit(known.distinct())


def test_duplicates_first_valid_wins(spark, make_rows, known):
    same = {"order_id": "ORD-AAAAAA"}
    rows = make_rows({**same, "amount": "x"}, same, same, {"order_id": "ORD-STORED"}, {**same, "run_id": 2})
    store = spark.createDataFrame([("ORD-STORED",)], "order_id string")
    per_run = checks.check_duplicates(checks.first_pass(rows, ORDERS, known), ORDERS, store)
    assert types(per_run) == ["invalid_amount", None, "duplicate_order_id", "duplicate_order_id", None]
    across = checks.check_duplicates(checks.first_pass(rows, ORDERS, known), ORDERS, store, across_runs=True)
    assert types(across)[-1] == "duplicate_order_id"


def brute_force(rows, stored):
    seen, out = set(stored), {}
    for run, index, key in sorted(rows):
        out[(run, index)] = key in seen
        seen.add(key)
    return out


@pytest.fixture(params=["10485760", "-1"])
def threshold(spark, request):
    """Small facts are broadcast by Spark's threshold; -1 forces the path for large facts."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield request.param
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("hot_rows", [10, 10**9])
def test_duplicates_with_a_hot_key(spark, make_rows, known, monkeypatch, hot_rows, threshold):
    """A key that holds a third of the rows, as a broadcast hot key and as an ordinary one."""
    monkeypatch.setattr(lookup.keyed_lookup, "__defaults__", ("n_rows", hot_rows))
    changes = [
        {"order_id": "ORD-HOTHOT" if i % 3 == 0 else f"ORD-{i // 2:06d}", "run_id": 1 + i // 60, "row_index": i}
        for i in range(180)
    ]
    store = spark.createDataFrame([("ORD-000001",)], "order_id string")
    checked = checks.first_pass(make_rows(*changes), ORDERS, known)
    marked = checks.check_duplicates(checked, ORDERS, store, across_runs=True).collect()
    want = brute_force([(c["run_id"], c["row_index"], c["order_id"]) for c in changes], {"ORD-000001"})
    assert {(r["run_id"], r["row_index"]): r["error_type"] is not None for r in marked} == want
    held = checks.store_duplicates(checked, ORDERS, store).collect()
    assert {r["row_index"] for r in held} == {c["row_index"] for c in changes if c["order_id"] == "ORD-000001"}


@pytest.mark.parametrize("hot_rows", [100, 10**9])
def test_keyed_lookup_spreads_rows_without_a_match(spark, hot_rows, threshold):
    rows = spark.range(1000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, F.lit("hot")).alias("k"))
    facts = spark.createDataFrame([("hot", 334, "yes"), ("cold", 1, "no")], "k string, n_rows bigint, v string")
    got = keyed_lookup(rows, facts, {"k": F.col("k")}, ["v"], F.col("i"), hot_rows=hot_rows)
    assert got.columns == ["i", "k", "v"]
    assert got.filter("v = 'yes'").count() == 334 and got.count() == 1000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("__salt" in plan) == (threshold == "-1")


def test_known_flag_keeps_every_row(spark, known):
    rows = spark.createDataFrame([(1, 0, "CUST-0001"), (1, 1, None), (1, 2, "x")], "run_id long, row_index long, k string")
    doubled = known.unionByName(known)
    got = known_flag(rows, F.col("k"), doubled, "ok", F.col("row_index")).orderBy("row_index").collect()
    assert [r["ok"] for r in got] == [True, False, False]


def test_schema_drift(spark, base):
    frame = spark.createDataFrame([{**base, "internal_notes": "x"}])
    with pytest.raises(checks.SchemaDriftError) as caught:
        checks.check_drift(frame, ORDERS)
    assert caught.value.unexpected_columns == {"internal_notes"}
    checks.check_drift(frame.limit(0), ORDERS)
    checks.check_drift(frame.select(*ORDERS.columns), ORDERS)


def test_ragged_rows(spark, base):
    raw = [
        (1, 0, {" Order_ID ": " ORD-000001 ", "STATUS": "pending"}),
        (1, 1, {**base, "Internal_Notes": "x"}),
    ]
    frame = spark.createDataFrame(raw, "run_id long, row_index long, raw map<string,string>")
    frame = frame.unionByName(
        spark.sql("SELECT 2L AS run_id, 0L AS row_index, map('order_id', 'first', 'ORDER_ID', 'last') AS raw")
    )
    rows = ragged_row_frame(frame, ORDERS).orderBy("run_id", "row_index").collect()
    assert rows[0]["order_id"] == "ORD-000001" and rows[0]["amount"] is None and rows[0]["status"] == "pending"
    assert rows[2]["order_id"] == "last"
    assert [tuple(r) for r in checks.ragged_drift(frame, ORDERS).collect()] == [(1, "internal_notes", 1)]


def test_colliding_headers_last_wins(spark):
    frame = spark.createDataFrame([("1", "2", " 3 ")], ["a", "A ", " a"])
    assert [r.asDict() for r in normalise_columns(frame).collect()] == [{"a": "3"}]


def test_row_index(spark):
    frame = spark.range(1000).repartition(7).select((F.col("id") * 3).alias("k"))
    placed = with_row_index(frame, order_by=["k"]).collect()
    assert sorted((r["k"], r["row_index"]) for r in placed) == [(3 * i, i) for i in range(1000)]
    unordered = with_row_index(frame).select("row_index").collect()
    assert sorted(r["row_index"] for r in unordered) == list(range(1000))


def test_contract_for_another_table(spark):
    """Rules are generic: optional fields, no keys."""
    items = Contract(
        "items",
        (
            Field("sku", Pattern("[A-Z]{3}[0-9]+")),
            Field("price", PositiveDecimal(6, 3), required=False),
            Field("unit", OneOf(("kg", "pc"))),
        ),
    )
    rows = spark.createDataFrame(
        [(1, 0, "ABC1", "", "kg"), (1, 1, "ABC1", "1.2345", "kg"), (1, 2, "ABC1", "999.999", "lb"), (1, 3, "xABC1", None, "pc")],
        "run_id long, row_index long, sku string, price string, unit string",
    )
    assert types(checks.check_contract(rows, items)) == [None, "invalid_price", "invalid_unit", "invalid_sku"]
    typed = checks.typed_rows(checks.first_pass(rows, items, None), items)
    assert dict(typed.dtypes)["price"] == "decimal(6,3)" and typed.first()["price"] is None
    with pytest.raises(ValueError):
        Contract("twice", (Field("a", Pattern("x")), Field("a", Pattern("y"))))
