"""Golden cases of the column functions."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from mendery.contract import CUSTOMER_ID_PATTERN, ORDER_ID_PATTERN, ORDERS
from mendery.functions.amounts import coerce_amount
from mendery.functions.dates import reformat_date
from mendery.functions.ids import fix_encoding
from mendery.functions.labels import heal_time_text, humanise, percent, run_summary
from mendery.functions.text import SPACE_CHARS, strip
from mendery.operators.faults import MOJIBAKE


def applied(spark, values, column):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in frame.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_strip_removes_what_python_strips(spark):
    assert set(SPACE_CHARS) == {chr(i) for i in range(0x110000) if chr(i).isspace()}
    values = [f"{c}a b{c}{c}" for c in SPACE_CHARS] + ["", "   ", None, "x"]
    assert applied(spark, values, strip) == [v.strip() if v is not None else None for v in values]


COERCE = {
    "$49.99": "49.99",
    "$1,234.56": "1234.56",
    "€1,234.56": "1234.56",
    "49,99": "4999",
    "$Infinity": "Infinity",
    "$1e2": "1e2",
    " 5": "5",
    "fifty-two": None,
    "49.99": None,
    "(49.99)": None,
    "49.99 CR": None,
    "49.99CR": None,
    "CR 49.99": None,
    "49.99 DR": None,
    "$0": None,
    "$-5": None,
    "$NaN": None,
    "$": None,
    "": None,
    None: None,
}


def test_coerce_amount(spark):
    assert applied(spark, list(COERCE), coerce_amount) == list(COERCE.values())


REFORMAT = {
    "01/07/2026": "2026-07-01",
    "25/12/26": "2026-12-25",
    "12/25/26": "2026-12-25",
    "12/25/2026": "2026-12-25",
    "01.07.2026": "2026-07-01",
    "01-07-2026": "2026-07-01",
    "2026/07/01": "2026-07-01",
    "2026-07-01T14:30:00": "2026-07-01",
    "July 1, 2026": "2026-07-01",
    "Jul 1, 2026": "2026-07-01",
    "1 July 2026": "2026-07-01",
    "1  jul 2026": "2026-07-01",
    "1/2/69": "1969-02-01",
    "1/2/68": "2068-02-01",
    "29/02/2024": "2024-02-29",
    "29/02/2026": None,
    "31/02/2026": None,
    "01/07/0000": None,
    "2026-07-01T24:00:00": None,
    "not-a-date": None,
    "2026-01-01": None,
    "": None,
    None: None,
}


def test_reformat_date(spark):
    assert applied(spark, list(REFORMAT), reformat_date) == list(REFORMAT.values())


MONTH_NAMES = "January February March April May June July August September October November December".split()


def written(y, m, d):
    """A date in the twelve layouts, with the ISO text that each must give: slashes are read day first
    where that makes a date, and two-digit years from 69 belong to the last century."""
    name, iso = MONTH_NAMES[m - 1], f"{y:04d}-{m:02d}-{d:02d}"
    century = f"{1900 + y % 100 if y % 100 >= 69 else 2000 + y % 100:04d}"
    swapped = f"-{d:02d}-{m:02d}" if d <= 12 else f"-{m:02d}-{d:02d}"
    return {
        f"{d:02d}/{m:02d}/{y:04d}": iso,
        f"{m:02d}/{d:02d}/{y:04d}": f"{y:04d}{swapped}",
        f"{d}-{m}-{y:04d}": iso,
        f"{y:04d}/{m}/{d:02d}": iso,
        f"{d:02d}/{m:02d}/{y % 100:02d}": f"{century}-{m:02d}-{d:02d}",
        f"{m:02d}/{d:02d}/{y % 100:02d}": f"{century}{swapped}",
        f"{d:02d}.{m:02d}.{y:04d}": iso,
        f"{iso}T08:05:09": iso,
        f"{name} {d}, {y:04d}": iso,
        f"{name[:3].upper()} {d:02d}, {y:04d}": iso,
        f"{d} {name.lower()}  {y:04d}": iso,
        f"{d:02d} {name[:3]} {y:04d}": iso,
    }


def test_reformat_date_in_all_layouts(spark):
    cases = {}
    for i in range(40):
        cases |= written(1969 + 3 * i, 1 + i % 12, 13 + (i * 7) % 16)
        cases |= written(1970 + 2 * i, 1 + i % 12, 1 + (i * 5) % 12)
    assert len(cases) > 800
    assert applied(spark, list(cases), reformat_date) == list(cases.values())


def test_reformat_date_at_the_edges(spark):
    cases = {
        "7/13/2026": "2026-07-13",
        "13/7/2026": "2026-07-13",
        "13/13/2026": None,
        "0/12/2026": None,
        "32/12/26": None,
        "5/ 6/2026": "2026-05-06",
        "7/12/26": "2026-12-07",
    }
    assert applied(spark, list(cases), reformat_date) == list(cases.values())


def test_fix_encoding(spark):
    order = ORDERS["order_id"].rule.anchored
    got = applied(
        spark,
        ["ORD-000001" + MOJIBAKE, "ORD-000001", "ORD-1" + MOJIBAKE, "ORD-000001\n", ""],
        lambda v: fix_encoding(v, order),
    )
    assert got == ["ORD-000001", None, None, "ORD-000001", None]
    assert ORDER_ID_PATTERN.startswith("^ORD-") and CUSTOMER_ID_PATTERN.startswith("^CUST-")


AMOUNTS = {
    "49.99": None,
    "1e2": None,
    ".5": None,
    "5.": None,
    "+5": None,
    "1_000": None,
    "49.990": None,
    "0000000000000005": None,
    "9999999999.99": None,
    "49.123": "decimal_max_places",
    "1e-3": "decimal_max_places",
    "12345678901": "decimal_whole_digits",
    "1e13": "decimal_max_digits",
    "0": "greater_than",
    "-5.00": "greater_than",
    "NaN": "finite_number",
    "Infinity": "finite_number",
    "1,000": "decimal_parsing",
    "": "decimal_parsing",
    None: "missing",
}


def test_amount_rule(spark):
    assert applied(spark, list(AMOUNTS), ORDERS["amount"].failure) == list(AMOUNTS.values())
    accepted = [k for k, v in AMOUNTS.items() if v is None]
    typed = applied(spark, accepted, ORDERS["amount"].rule.typed)
    assert typed == [Decimal(k.replace("_", "")) for k in accepted]


DATES = {
    "2026-07-01": date(2026, 7, 1),
    "2026-01-01T00:00:00": date(2026, 1, 1),
    "2026-01-01 00:00": date(2026, 1, 1),
    "2026-01-01T00:00:00Z": date(2026, 1, 1),
    "1767225600": date(2026, 1, 1),
    "1767225600000": date(2026, 1, 1),
    "0": date(1970, 1, 1),
    "-86400": date(1969, 12, 31),
    "0001-01-01": date(1, 1, 1),
    "2026-7-1": None,
    "2026/01/01": None,
    "20260701": None,
    "2026-07-01T14:30:00": None,
    "2026-02-29": None,
    "0000-01-01": None,
    "2026-07-01 garbage": None,
    "2026": None,
    "": None,
}


def test_date_rule(spark):
    rule = ORDERS["order_date"].rule
    failures = applied(spark, list(DATES), rule.failure)
    assert [f is None for f in failures] == [v is not None for v in DATES.values()]
    accepted = [k for k, v in DATES.items() if v]
    assert applied(spark, accepted, rule.typed) == [DATES[k] for k in accepted]


def test_rules_agree_with_pydantic(spark):
    """The contract accepts what a pydantic model with the same constraints accepts."""
    pydantic = pytest.importorskip("pydantic")

    class Model(pydantic.BaseModel):
        amount: Decimal = pydantic.Field(gt=0, max_digits=12, decimal_places=2)
        order_date: date

    def kind(field, value):
        try:
            Model(**{"amount": "1", "order_date": "2026-01-01", field: value})
        except pydantic.ValidationError as exc:
            return exc.errors()[0]["type"]

    pieces = ["0", "1", "00", "99", ".", "-", "+", "e", "E2", "_", "5", "123456"]
    amounts = [a + b + c for a in pieces for b in pieces for c in pieces]
    assert applied(spark, amounts, ORDERS["amount"].failure) == [kind("amount", v) for v in amounts]
    dates = [k for k in DATES if k not in ("0000-01-01",)] + ["2026-01-01T00:00:00+05:30", "2026-01-01T00:00:60", "1e5"]
    assert applied(spark, dates, ORDERS["order_date"].rule.failure) == [kind("order_date", v) for v in dates]


def test_labels(spark):
    raw = ["invalid_amount", "fix_encoding", "duplicate_order_id", "invalid_customer_id", "healed"]
    assert applied(spark, raw, humanise) == [
        "Invalid amount", "Fix encoding", "Duplicate order ID", "Invalid customer ID", "Healed",
    ]


def test_heal_time_and_percent(spark):
    values = [0.03, 0.4, 4.2, 842.7, 0.0, 1.25]
    texts = applied(spark, [str(v) for v in values], lambda v: heal_time_text(v.cast("double")))
    assert texts == ["0.03 ms/row", "0.40 ms/row", "4.2 ms/row", "843 ms/row", "0 ms/row", "1.3 ms/row"]
    assert applied(spark, ["0.6125", "0.5"], lambda v: percent(v.cast("double"))) == [61.3, 50.0]


SUMMARIES = [
    (("completed", 60, 10, 23, {"invalid_order_date": 10, "invalid_amount": 5}, {"reformat_date": 10}),
     "33 rows had errors (mostly invalid order date), 10 auto-fixed (mainly reformat date), 23 quarantined."),
    (("completed", 60, 0, 0, {}, {}), "All 60 rows clean, no repairs needed."),
    (("completed", 60, 0, 33, {"invalid_order_date": 10}, {}), "33 rows had errors (mostly invalid order date), 33 quarantined."),
    (("completed", 60, 33, 0, {"invalid_order_date": 33}, {"reformat_date": 33}),
     "33 rows had errors (mostly invalid order date), 33 auto-fixed (mainly reformat date)."),
    (("completed", 60, 0, 1, {"invalid_amount": 1}, {}), "1 row had errors (mostly invalid amount), 1 quarantined."),
    (("completed", 9, 1, 0, {}, {}), "1 row had errors (mixed causes), 1 auto-fixed."),
    (("rejected_schema_drift", 5, 0, 0, {}, {}), "Batch rejected: unexpected column(s) in the CSV (schema drift)."),
    (("failed", 5, 0, 0, {}, {}), "Run failed unexpectedly partway through."),
    (("running", 5, 0, 0, {}, {}), "Still running..."),
]


def test_run_summary(spark):
    schema = "status string, n bigint, healed bigint, q bigint, e map<string,bigint>, f map<string,bigint>, i int"
    frame = spark.createDataFrame([(*args, i) for i, (args, _) in enumerate(SUMMARIES)], schema)
    text = run_summary(*[F.col(c) for c in ("status", "n", "healed", "q", "e", "f")])
    assert [r["t"] for r in frame.select("i", text.alias("t")).orderBy("i").collect()] == [s for _, s in SUMMARIES]


def outside_codegen(frame):
    """Operators of the plan, with AQE off, that are not inside whole-stage code generation."""
    spark = frame.sparkSession
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = frame._jdf.queryExecution().executedPlan().treeString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    return [line for line in text.splitlines() if "Project [" in line and "*(" not in line]


def test_contract_stays_in_generated_code(spark, make_rows):
    from mendery.operators.checks import check_contract, typed_rows

    checked = check_contract(make_rows({}, {"amount": "1e2"}, {"amount": "x"}), ORDERS)
    assert outside_codegen(checked.select("row_index", "fail_amount", "fail_order_date", "error_type")) == []
    assert outside_codegen(typed_rows(checked, ORDERS)) == []
    # and that code compiles: without the fallback a method that is too long is an error
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        kinds = checked.filter("fail_amount IS NOT NULL").select("fail_amount", "error_type").collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert [r.fail_amount for r in kinds] == ["decimal_parsing"]
