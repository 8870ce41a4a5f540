"""Registered queries: every operator over the messy orders or the other given tables.

``QUERIES`` maps a name to ``(spark, folder) -> DataFrame``; ``ORACLE`` maps it to the DuckDB statement that
must give the same rows. Count maps, structs and arrays are flattened to plain columns, and decimals and
dates are shown as doubles and texts, so that both engines can be compared value by value.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendery.contract import ORDERS, built_in_transforms
from mendery.functions.amounts import coerce_amount
from mendery.functions.dates import reformat_date
from mendery.functions.ids import fix_encoding
from mendery.functions.labels import heal_time_text, humanise
from mendery.functions.text import is_blank
from mendery.operators import checks, faults
from mendery.operators.external import parse_response
from mendery.operators.repair import RepairLoop, candidate_fix, computed_once, first_diagnosis, repair_rows
from mendery.operators.row_index import with_row_index
from mendery.plans import analytics, oracle, running
from mendery.plans import outcomes as out
from mendery.plans.oracle import FIELDS, FIRST_PASS, TABLES, settled_stages, statement
from mendery.plans.run import run_batch
from mendery.plans.sample_orders import (
    existing_orders,
    known_customers,
    messy_orders,
    raw_orders,
    table,
    with_run_state,
)
from mendery.session import scratch_path, settle_table
from mendery.sources.csv import csv_layout, read_csv, write_csv
from mendery.sources.rows import normalise_columns, ragged_row_frame
from mendery.sources.tables import Store, known_keys
from mendery.streaming.arrivals import process_arrivals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
RULES = out.Rules()
_SETTLED: dict[tuple[str, str], DataFrame] = {}
_STORES: dict[tuple[str, str], Store] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return query

    return add


def shown(frame: DataFrame) -> DataFrame:
    """Clean rows with decimals as doubles and dates as text."""
    return frame.withColumns({"amount": F.col("amount").cast("double"), "order_date": F.col("order_date").cast("string")})


# -------------------------------------------------------------------------------- the frames


def checked_orders(spark: SparkSession, folder: str) -> DataFrame:
    return checks.first_pass(messy_orders(spark, folder), ORDERS, known_customers(spark, folder))


def repaired_orders(spark: SparkSession, folder: str, attempts: int = 3) -> DataFrame:
    bad = checks.invalid_rows(checked_orders(spark, folder))
    return repair_rows(bad, ORDERS, known_customers(spark, folder), max_attempts=attempts)


def settled_orders(spark: SparkSession, folder: str) -> DataFrame:
    """All rows with their disposition: written once per session and folder, since a dozen queries read it."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _SETTLED:
        rows = out.outcomes(
            messy_orders(spark, folder), known_customers(spark, folder), existing_orders(spark, folder), RULES
        )
        _SETTLED[key] = settle_table(rows, "settled-orders")
    return _SETTLED[key]


def stored_orders(spark: SparkSession, folder: str) -> Store:
    """The output tables of all runs, one folder per run: written once per session and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORES:
        store = Store(spark, scratch_path(spark, "tables"), ORDERS)
        settled = settled_orders(spark, folder)
        done = table(spark, folder, "orders").filter("o_orderkey % 5 = 0").select(
            (F.floor(F.col("o_orderkey") / 500).cast("bigint") + 1).alias("run_id"),
            F.col("o_orderkey").alias("row_index"),
        )
        tables = {
            "runs": with_run_state(out.run_counts(settled, RULES)),
            "audit": out.audit_rows(settled, ORDERS),
            "quarantine": out.quarantine_rows(settled, ORDERS),
        }
        for name, rows in tables.items():
            rows.repartition("run_id").write.partitionBy("run_id").parquet(store.path(name))
        done.write.parquet(store.path("resolutions"))
        _STORES[key] = store
    return _STORES[key]


def runs_table(spark: SparkSession, folder: str) -> DataFrame:
    return stored_orders(spark, folder).runs()


def audit_table(spark: SparkSession, folder: str) -> DataFrame:
    return stored_orders(spark, folder).audit().drop("created_at")


def quarantine_table(spark: SparkSession, folder: str) -> DataFrame:
    """Quarantine with every fifth row resolved."""
    return stored_orders(spark, folder).quarantine().drop("created_at")


def ragged_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Messy orders as maps with untidy keys; one row in forty has no status, some runs carry a note."""
    raw = raw_orders(spark, folder)
    names = {"order_id": " Order_ID ", "customer_id": "CUSTOMER_ID", "status": "status\t"}

    def entry(name: str) -> Column:
        return F.struct(F.lit(names.get(name, name)).alias("key"), F.col(name).alias("value"))

    always = F.array(*[entry(n) for n in FIELDS if n != "status"])
    none = F.array().cast("array<struct<key:string,value:string>>")
    status = F.when(F.col("mode") != 30, F.array(entry("status"))).otherwise(none)
    note = F.array(F.struct(F.lit("Internal_Notes").alias("key"), F.lit("flagged").alias("value")))
    drifted = (F.col("run_id") % 3 == 0) & (F.col("mode") == 5)
    return raw.select(
        "run_id",
        "row_index",
        F.map_from_entries(F.concat(always, status, F.when(drifted, note).otherwise(none))).alias("raw"),
    )


# ------------------------------------------------------------------------------ scans, sinks

_NORM = FIRST_PASS[:3]
_NORM_ROWS = statement(_NORM, f"SELECT row_index, {', '.join(FIELDS)} FROM norm")


@register("s1_csv_scan", _NORM_ROWS)
def s1_csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Write the untrimmed rows as CSV with an untidy header, read them back normalised."""
    path = scratch_path(spark, "csv-scan")
    raw = raw_orders(spark, folder).select("row_index", *[F.col(n).alias(f" {n.upper()} ") for n in FIELDS])
    write_csv(path, raw)
    rows = read_csv(spark, path)
    return rows.select(F.col("row_index").cast("bigint").alias("row_index"), *FIELDS)


@register(
    "s3_row_scan",
    statement(
        _NORM,
        f"SELECT run_id, row_index, {', '.join(f for f in FIELDS if f != 'status')}, "
        "CASE WHEN mode = 30 THEN NULL ELSE status END AS status FROM norm",
    ),
)
def s3_row_scan(spark: SparkSession, folder: str) -> DataFrame:
    return ragged_row_frame(ragged_orders(spark, folder), ORDERS)


@register("s4_header_names", statement(_NORM, "SELECT row_index, status AS order_id, amount FROM norm"))
def s4_header_names(spark: SparkSession, folder: str) -> DataFrame:
    """Headers that collide once trimmed and lower-cased: the last column wins."""
    raw = raw_orders(spark, folder)
    untidy = raw.select("row_index", "order_id", "amount", "status").toDF("row_index", "Order_ID", " Amount", "order_id ")
    return normalise_columns(untidy, keep=("row_index",))


@register("s5_value_trim", _NORM_ROWS)
def s5_value_trim(spark: SparkSession, folder: str) -> DataFrame:
    return messy_orders(spark, folder).select("row_index", *FIELDS)


@register("s7_row_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders")
def s7_row_index(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "orders").select("o_orderkey")
    return with_row_index(keys, order_by=["o_orderkey"])


@register(
    "s8_known_customers",
    "SELECT DISTINCT concat('CUST-', lpad(cast(o_custkey AS string), 12, '0')) AS customer_id FROM orders",
)
def s8_known_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers seen in the orders; the key is reduced before it is rendered as text."""
    seen = known_keys(table(spark, folder, "orders"), "o_custkey")
    return seen.select(F.concat(F.lit("CUST-"), F.lpad(F.col("o_custkey").cast("string"), 12, "0")).alias("customer_id"))


@register(
    "s9_existing_orders",
    "SELECT DISTINCT concat('ORD-', lpad(cast(l_orderkey AS string), 12, '0')) AS order_id FROM lineitem",
)
def s9_existing_orders(spark: SparkSession, folder: str) -> DataFrame:
    seen = known_keys(table(spark, folder, "lineitem"), "l_orderkey")
    return seen.select(F.concat(F.lit("ORD-"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0")).alias("order_id"))


@register(
    "s11_csv_layout",
    "SELECT cast(c_custkey AS string) AS key, c_name AS name, '' AS status FROM customer "
    "UNION ALL SELECT cast(o_orderkey AS string), '', o_orderstatus FROM orders",
)
def s11_csv_layout(spark: SparkSession, folder: str) -> DataFrame:
    """Tables with different columns under one sorted header, exported and read back."""
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    path = scratch_path(spark, "csv-export")
    write_csv(path, csv_layout(customers, orders))
    return read_csv(spark, path)


_SINGLE = settled_stages(store=False, many_runs=False)
_TABLE_COUNTS = statement(
    [*_SINGLE, oracle.AUDIT],
    "SELECT 'clean' AS name, count(*) AS n_rows FROM settled WHERE disposition <> 'quarantined' "
    "UNION ALL SELECT 'healed', count(*) FROM settled WHERE disposition = 'healed' "
    "UNION ALL SELECT 'quarantine', count(*) FROM settled WHERE disposition = 'quarantined' "
    "UNION ALL SELECT 'audit', count(*) FROM audit "
    "UNION ALL SELECT concat('run ', error_type), count(*) FROM settled WHERE error_type IS NOT NULL GROUP BY ALL",
)


def _written(store: Store) -> DataFrame:
    """Rows per written table, and the error counts of the run rows."""

    def counted(name: str, frame: DataFrame) -> DataFrame:
        return frame.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"))

    parts = [
        counted("clean", store.clean()),
        counted("healed", store.clean().filter("origin = 'healed'")),
        counted("quarantine", store.quarantine()),
        counted("audit", store.audit()),
        store.runs()
        .select(F.explode("error_types").alias("key", "n"))
        .groupBy(F.concat(F.lit("run "), F.col("key")).alias("name"))
        .agg(F.sum("n").alias("n_rows")),
    ]
    return reduce(DataFrame.unionByName, parts)


@register("s12_table_sinks", _TABLE_COUNTS)
def s12_table_sinks(spark: SparkSession, folder: str) -> DataFrame:
    """One tracked run over all messy orders, counted from the tables it wrote."""
    store = Store(spark, scratch_path(spark, "store"), ORDERS)
    rows = messy_orders(spark, folder).drop("run_id")
    run_batch(store, rows, known_customers(spark, folder), 1, row_index="row_index")
    return _written(store)


@register("t1_arriving_files", _TABLE_COUNTS)
def t1_arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows as files in a landing folder, processed as a stream."""
    landing = scratch_path(spark, "landing")
    write_csv(landing, raw_orders(spark, folder).select(*FIELDS))
    store = Store(spark, scratch_path(spark, "store"), ORDERS)
    stream = process_arrivals(store, landing, known_customers(spark, folder), scratch_path(spark, "stream"))
    stream.awaitTermination()
    return _written(store)


# -------------------------------------------------------------------------------- validation


@register(
    "v1_schema_drift",
    statement(
        _NORM[:1],
        "SELECT run_id, 'internal_notes' AS column_name, count(*) AS n_rows FROM messy "
        "WHERE run_id % 3 = 0 AND mode = 5 GROUP BY run_id",
    ),
)
def v1_schema_drift(spark: SparkSession, folder: str) -> DataFrame:
    return checks.ragged_drift(ragged_orders(spark, folder), ORDERS)


_BLANK_OR_MISSING = " UNION ALL ".join(
    f"SELECT row_index, '{f}' AS field, {oracle.kind(f, f)} AS kind FROM g WHERE {f} IS NULL OR {f} = ''" for f in FIELDS
)


@register(
    "v2_required_fields",
    statement(
        [*_NORM, "g AS (SELECT * REPLACE (CASE WHEN mode = 30 THEN NULL ELSE status END AS status) FROM norm)"],
        _BLANK_OR_MISSING,
    ),
)
def v2_required_fields(spark: SparkSession, folder: str) -> DataFrame:
    judged = checks.check_contract(ragged_row_frame(ragged_orders(spark, folder), ORDERS), ORDERS)
    failing = ORDERS.failing(checks.value_of, checks.kind_of, F.lit(None).cast("string"))
    kinds = F.create_map(*[x for n in FIELDS for x in (F.lit(n), checks.kind_of(n))])
    flat = judged.select("row_index", kinds.alias("kinds"), F.explode(failing).alias("e"))
    return flat.filter(is_blank(F.col("e.value"))).select(
        "row_index", F.col("e.field").alias("field"), F.col("kinds")[F.col("e.field")].alias("kind")
    )


def _field_query(name: str, field: str) -> None:
    sql = statement(FIRST_PASS, f"SELECT row_index, {field} AS value, k_{field} AS kind FROM checked WHERE k_{field} IS NOT NULL")

    @register(name, sql)
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = messy_orders(spark, folder)
        kind = ORDERS[field].failure(F.col(field))
        return rows.select("row_index", F.col(field).alias("value"), kind.alias("kind")).filter("kind IS NOT NULL")


for _name, _field in (
    ("v3_order_id", "order_id"),
    ("v4_customer_id", "customer_id"),
    ("v5_order_date", "order_date"),
    ("v6_amount", "amount"),
    ("v7_currency", "currency"),
    ("v8_status", "status"),
):
    _field_query(_name, _field)


@register(
    "v9_all_errors",
    statement(FIRST_PASS, f"SELECT row_index, {oracle.DETAIL} AS detail FROM checked WHERE contract_type IS NOT NULL"),
)
def v9_all_errors(spark: SparkSession, folder: str) -> DataFrame:
    judged = checks.check_contract(messy_orders(spark, folder), ORDERS)
    bad = checks.with_errors(checks.invalid_rows(judged), ORDERS)
    return bad.select("row_index", out.error_detail(ORDERS).alias("detail"))


@register(
    "v10_error_type",
    statement(FIRST_PASS, "SELECT run_id, contract_type AS error_type, count(*) AS n_rows FROM checked WHERE contract_type IS NOT NULL GROUP BY ALL"),
)
def v10_error_type(spark: SparkSession, folder: str) -> DataFrame:
    judged = checks.check_contract(messy_orders(spark, folder), ORDERS)
    return checks.invalid_rows(judged).groupBy("run_id", "error_type").agg(F.count("*").alias("n_rows"))


@register(
    "v11_foreign_key",
    statement(FIRST_PASS, f"SELECT row_index, order_id, customer_id, {oracle.DETAIL} AS detail FROM checked WHERE error_type = 'invalid_foreign_key'"),
)
def v11_foreign_key(spark: SparkSession, folder: str) -> DataFrame:
    bad = checked_orders(spark, folder).filter("error_type = 'invalid_foreign_key'")
    return bad.select("row_index", "order_id", "customer_id", out.error_detail(ORDERS).alias("detail"))


@register(
    "v11_unknown_customers",
    statement(FIRST_PASS, "SELECT customer_id, count(*) AS n_rows FROM checked WHERE contract_type IS NULL AND NOT key_known GROUP BY ALL"),
)
def v11_unknown_customers(spark: SparkSession, folder: str) -> DataFrame:
    judged = checks.check_contract(messy_orders(spark, folder), ORDERS)
    unknown = checks.unknown_keys(judged, ORDERS, known_customers(spark, folder))
    return unknown.groupBy("customer_id").agg(F.count("*").alias("n_rows"))


@register(
    "v12_store_duplicates",
    statement(
        [*FIRST_PASS, oracle._HELD],
        "SELECT run_id, row_index, order_id FROM checked WHERE error_type IS NULL AND order_id IN (SELECT order_id FROM held)",
    ),
)
def v12_store_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = checks.store_duplicates(checked_orders(spark, folder), ORDERS, existing_orders(spark, folder))
    return found.select("run_id", "row_index", "order_id")


@register(
    "v13_batch_duplicates",
    statement(
        FIRST_PASS,
        "SELECT run_id, row_index, order_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, order_id ORDER BY row_index) AS nth "
        "FROM checked WHERE error_type IS NULL) WHERE nth > 1",
    ),
)
def v13_batch_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    marked = checks.check_duplicates(checked_orders(spark, folder), ORDERS, None)
    return marked.filter("error_type = 'duplicate_order_id'").select("run_id", "row_index", "order_id")


@register(
    "v14_valid_invalid",
    statement(
        FIRST_PASS,
        "SELECT run_id, count(*) FILTER (error_type IS NULL) AS n_valid, count(*) FILTER (error_type IS NOT NULL) AS n_invalid "
        "FROM checked GROUP BY run_id",
    ),
)
def v14_valid_invalid(spark: SparkSession, folder: str) -> DataFrame:
    return checked_orders(spark, folder).groupBy("run_id").agg(
        F.count_if(F.col("error_type").isNull()).alias("n_valid"),
        F.count_if(F.col("error_type").isNotNull()).alias("n_invalid"),
    )


@register(
    "v15_typed_rows",
    statement(
        FIRST_PASS,
        "SELECT run_id, row_index, order_id, customer_id, cast(cast(order_date AS date) AS string) AS order_date, "
        "cast(cast(amount AS decimal(12,2)) AS double) AS amount, currency, status FROM checked WHERE error_type IS NULL",
    ),
)
def v15_typed_rows(spark: SparkSession, folder: str) -> DataFrame:
    return shown(checks.typed_rows(checked_orders(spark, folder), ORDERS))


@register(
    "error_type_counts",
    statement(
        settled_stages(store=False),
        "SELECT error_type, count(*) AS n_rows FROM (SELECT CASE WHEN error_type IS NULL AND nth > 1 THEN 'duplicate_order_id' "
        "ELSE coalesce(error_type, 'none') END AS error_type FROM (SELECT *, row_number() OVER (PARTITION BY run_id, error_type IS NULL, order_id "
        "ORDER BY row_index) AS nth FROM checked)) GROUP BY ALL",
    ),
)
def error_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Trim, contract, known keys and duplicates together: rows per error type."""
    marked = checks.check_duplicates(checked_orders(spark, folder), ORDERS, None)
    kind = F.coalesce("error_type", F.lit("none"))
    return marked.groupBy(kind.alias("error_type")).agg(F.count("*").alias("n_rows"))


# --------------------------------------------------------------------------------- diagnosis


def diagnosed(spark: SparkSession, folder: str) -> DataFrame:
    """First diagnosis of every invalid row, duplicates included."""
    marked = checks.check_duplicates(checked_orders(spark, folder), ORDERS, None)
    loop = RepairLoop(ORDERS, built_in_transforms(ORDERS))
    bad = checks.invalid_rows(marked).withColumn("__stripped_known", F.lit(False))
    start, failing, heuristic = first_diagnosis(loop)
    bad = computed_once(bad, __state=start)
    bad = computed_once(bad, failing=failing)
    return computed_once(bad, d=heuristic)


_WITH_DUPLICATES = """marked AS (SELECT * REPLACE (CASE WHEN error_type IS NULL AND row_number() OVER
    (PARTITION BY run_id, error_type IS NULL, order_id ORDER BY row_index) > 1 THEN 'duplicate_order_id' ELSE error_type END AS error_type)
  FROM checked)"""
_DIAGNOSED = [*FIRST_PASS, _WITH_DUPLICATES, oracle.start_stage("marked"), *oracle.diagnosis_stages("s0", "1")]
_DIAGNOSIS = "SELECT row_index, error_type, hypothesis, transform, confidence, reasoning FROM d1 WHERE "


def _diagnosis_query(name: str, spark_filter: str, sql_filter: str) -> None:
    @register(name, statement(_DIAGNOSED, _DIAGNOSIS + sql_filter))
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return diagnosed(spark, folder).filter(spark_filter).select(
            "row_index", "error_type", "d.hypothesis", "d.transform", "d.confidence", "d.reasoning"
        )


_BLANK_TEXT = "hypothesis LIKE '% is missing or blank'"
_OTHER_TEXT = "hypothesis LIKE '% fails validation and no registered transform applies'"
_diagnosis_query("d1_unknown_key", "error_type = 'invalid_foreign_key'", "error_type = 'invalid_foreign_key'")
_diagnosis_query("d2_duplicate", "error_type = 'duplicate_order_id'", "error_type = 'duplicate_order_id'")
_diagnosis_query("d3_fixable_field", "d.transform IS NOT NULL", "transform IS NOT NULL")
_diagnosis_query("d4_blank_field", f"d.{_BLANK_TEXT}", _BLANK_TEXT)
_diagnosis_query("d5_nothing_applies", f"d.{_OTHER_TEXT}", _OTHER_TEXT)


# One SQL text for both engines: answers of many shapes to the rows of the orders table.
_RESPONSES = """SELECT o_orderkey AS k, CASE o_orderkey % 9
  WHEN 0 THEN concat('{"hypothesis": "h', cast(o_orderkey AS string), '", "transform": "coerce_amount", "confidence": 0.75, "reasoning": "r"}')
  WHEN 1 THEN '{"hypothesis": "h", "transform": "reformat_date", "confidence": "0.5", "reasoning": "quoted"}'
  WHEN 2 THEN 'not json at all'
  WHEN 3 THEN '{"hypothesis": "h", "transform": "fix_encoding", "confidence": 1.5, "reasoning": "r"}'
  WHEN 4 THEN '{"hypothesis": "h", "transform": "drop_row", "confidence": 0.9, "reasoning": "r"}'
  WHEN 5 THEN '{"hypothesis": "h", "transform": "no_fix", "confidence": 1}'
  WHEN 6 THEN '{"hypothesis": "h", "transform": "no_fix", "confidence": 1, "reasoning": "none"}'
  WHEN 7 THEN '{"hypothesis": "h", "transform": null, "confidence": 0.9, "reasoning": "r"}'
  ELSE '{"hypothesis": "h", "transform": "no_fix", "confidence": "high", "reasoning": "r"}' END AS response
FROM {orders}"""


@register(
    "d9_response_check",
    "WITH r AS (" + _RESPONSES.replace("{orders}", "orders") + """),
p AS (SELECT k, json_valid(response) AS ok, CASE WHEN json_valid(response) THEN response END AS j FROM r),
q AS (SELECT k, j ->> '$.hypothesis' AS hypothesis, j ->> '$.transform' AS transform, j ->> '$.reasoning' AS reasoning,
  try_cast(j ->> '$.confidence' AS double) AS confidence, ok FROM p),
v AS (SELECT *, CASE WHEN NOT ok OR hypothesis IS NULL OR transform IS NULL OR reasoning IS NULL OR confidence IS NULL THEN 'unparseable'
  WHEN confidence < 0 OR confidence > 1 THEN 'out of range'
  WHEN transform NOT IN ('no_fix', 'coerce_amount', 'reformat_date', 'fix_encoding') THEN 'unknown transform' ELSE 'accepted' END AS verdict FROM q)
SELECT k, verdict, CASE WHEN verdict = 'accepted' THEN hypothesis END AS hypothesis,
  CASE WHEN verdict = 'accepted' AND transform <> 'no_fix' THEN transform END AS transform,
  coalesce(CASE WHEN verdict = 'accepted' THEN confidence END, -1.0) AS confidence FROM v""",
)
def d9_response_check(spark: SparkSession, folder: str) -> DataFrame:
    answers = _responses(spark, folder)
    parsed = answers.withColumn("p", parse_response(F.col("response"), built_in_transforms(ORDERS).ids))
    error, made = F.col("p.error"), F.col("p.diagnosis")
    verdict = (
        F.when(error.isNull(), F.lit("accepted"))
        .when(error.startswith("unparseable"), F.lit("unparseable"))
        .when(error.startswith("confidence"), F.lit("out of range"))
        .otherwise(F.lit("unknown transform"))
    )
    return parsed.select(
        "k",
        verdict.alias("verdict"),
        made["hypothesis"].alias("hypothesis"),
        made["transform"].alias("transform"),
        F.coalesce(made["confidence"], F.lit(-1.0)).alias("confidence"),
    )


def _responses(spark: SparkSession, folder: str) -> DataFrame:
    body = _RESPONSES.removeprefix("SELECT ").removesuffix("\nFROM {orders}")
    key, answer = body.split(", ", 1)
    return table(spark, folder, "orders").selectExpr(key, answer)


# ------------------------------------------------------------------------------------ repair


@register(
    "r1_coerce_amount",
    statement(_NORM, f"SELECT row_index, amount, {oracle.coerce('amount')} AS fixed, {oracle.coerce('order_id')} AS fixed_id FROM norm"),
)
def r1_coerce_amount(spark: SparkSession, folder: str) -> DataFrame:
    return messy_orders(spark, folder).select(
        "row_index", "amount", coerce_amount(F.col("amount")).alias("fixed"), coerce_amount(F.col("order_id")).alias("fixed_id")
    )


# The twelve layouts that reformat_date knows.
_LAYOUTS = [
    "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%Y/%m/%d", "%d/%m/%y", "%m/%d/%y", "%d.%m.%Y",
    "%Y-%m-%dT%H:%M:%S", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y",
]
_MONTHS = "January February March April May June July August September October November December".split()


def _written_date(layout: str) -> str:
    """SQL, valid in both engines, that writes the ship date of a line item in a layout."""
    month = "CASE substr(t, 6, 2) " + " ".join(f"WHEN '{i:02d}' THEN '{name}'" for i, name in enumerate(_MONTHS, 1)) + " END"
    parts = {
        "Y": "substr(t, 1, 4)", "y": "substr(t, 3, 2)", "m": "substr(t, 6, 2)", "d": "substr(t, 9, 2)",
        "B": month, "b": f"substr({month}, 1, 3)", "H": "'08'", "M": "'05'", "S": "'09'",
    }
    pieces = [p for p in re.split("%(.)", layout) if p]
    letters = set(re.findall("%(.)", layout))
    return "concat(" + ", ".join(parts[p] if p in letters and len(p) == 1 else f"'{p}'" for p in pieces) + ")"


_DATES_SQL = (
    "SELECT k, line, CASE k % 13 "
    + " ".join(f"WHEN {i} THEN {_written_date(layout)}" for i, layout in enumerate(_LAYOUTS))
    + " ELSE t END AS written FROM (SELECT l_orderkey AS k, l_linenumber AS line, cast(cast(l_shipdate AS date) AS string) AS t FROM {lineitem}) b"
)


@register(
    "r2_reformat_date",
    f"WITH w AS ({_DATES_SQL.format(lineitem='lineitem')}) SELECT k, line, written, {oracle.reformat('written')} AS fixed FROM w",
)
def r2_reformat_date(spark: SparkSession, folder: str) -> DataFrame:
    """Ship dates in all twelve layouts, and in the ISO form that needs no repair."""
    items = table(spark, folder, "lineitem")
    written = spark.sql(_DATES_SQL, lineitem=items)
    return written.withColumn("fixed", reformat_date(F.col("written")))


@register(
    "r3_fix_encoding",
    statement(
        _NORM,
        f"SELECT row_index, {oracle.fix('order_id', 'order_id')} AS order_id, {oracle.fix('customer_id', 'customer_id')} AS customer_id FROM norm",
    ),
)
def r3_fix_encoding(spark: SparkSession, folder: str) -> DataFrame:
    fixed = [fix_encoding(F.col(n), ORDERS[n].rule.anchored).alias(n) for n in ("order_id", "customer_id")]
    return messy_orders(spark, folder).select("row_index", *fixed)


@register(
    "r5_candidate_search",
    statement(
        [*_DIAGNOSED, oracle.candidate_stage("1")],
        "SELECT row_index, transform, fix_field AS field, fix_value AS fixed FROM x1 WHERE transform IS NOT NULL",
    ),
)
def r5_candidate_search(spark: SparkSession, folder: str) -> DataFrame:
    proposed = diagnosed(spark, folder).filter("d.transform IS NOT NULL")
    fix = candidate_fix(F.col("d.transform"), F.col("failing"), built_in_transforms(ORDERS))
    return computed_once(proposed, fix=fix).select(
        "row_index", F.col("d.transform").alias("transform"), F.col("fix.field").alias("field"), F.col("fix.fixed").alias("fixed")
    )


_LOOP_ROWS = "SELECT row_index, healed, end_reason, len(attempts) AS n_attempts, {} FROM repaired".format(", ".join(FIELDS))


def _loop_rows(repaired: DataFrame) -> DataFrame:
    return repaired.select(
        "row_index",
        "healed",
        "end_reason",
        F.size("attempts").cast("bigint").alias("n_attempts"),
        *[F.col(f"final.{n}").alias(n) for n in FIELDS],
    )


@register("r6_revalidation", statement([*FIRST_PASS, *oracle.loop_stages(1)], _LOOP_ROWS))
def r6_revalidation(spark: SparkSession, folder: str) -> DataFrame:
    """A loop of one attempt: what re-validation says about the first repair."""
    return _loop_rows(repaired_orders(spark, folder, 1))


@register("r7_bounded_loop", statement([*FIRST_PASS, *oracle.loop_stages()], _LOOP_ROWS))
def r7_bounded_loop(spark: SparkSession, folder: str) -> DataFrame:
    return _loop_rows(repaired_orders(spark, folder))


@register(
    "r8_end_reason",
    statement(
        [*FIRST_PASS, *oracle.loop_stages()],
        "SELECT error_type, coalesce(end_reason, 'healed') AS end_reason, count(*) AS n_rows FROM repaired GROUP BY ALL",
    ),
)
def r8_end_reason(spark: SparkSession, folder: str) -> DataFrame:
    ended = F.coalesce("end_reason", F.lit("healed")).alias("end_reason")
    return repaired_orders(spark, folder).groupBy("error_type", ended).agg(F.count("*").alias("n_rows"))


# ----------------------------------------------------------------------------------- outputs


@register(
    "o1_clean_store",
    statement(
        TABLES,
        "SELECT run_id, row_index, disposition, final_order_id AS order_id, final_customer_id AS customer_id, "
        "cast(cast(final_order_date AS date) AS string) AS order_date, cast(cast(final_amount AS decimal(12,2)) AS double) AS amount, "
        "final_currency AS currency, final_status AS status FROM settled WHERE disposition <> 'quarantined'",
    ),
)
def o1_clean_store(spark: SparkSession, folder: str) -> DataFrame:
    return shown(out.clean_rows(settled_orders(spark, folder), ORDERS))


@register(
    "o2_quarantine_rows",
    statement(TABLES, f"SELECT run_id, row_index, {', '.join(FIELDS)}, error_type, attempt_count, end_reason, resolved FROM quarantine"),
)
def o2_quarantine_rows(spark: SparkSession, folder: str) -> DataFrame:
    return quarantine_table(spark, folder).select(
        "run_id",
        "row_index",
        *[F.col("original_data")[n].alias(n) for n in FIELDS],
        "error_type",
        F.col("attempt_count").cast("bigint").alias("attempt_count"),
        "end_reason",
        "resolved",
    )


@register("o3_error_detail", statement(TABLES, "SELECT run_id, row_index, error_detail FROM quarantine"))
def o3_error_detail(spark: SparkSession, folder: str) -> DataFrame:
    return out.quarantine_rows(settled_orders(spark, folder), ORDERS).select("run_id", "row_index", "error_detail")


@register(
    "o4_diagnosis_history",
    statement(
        TABLES,
        "SELECT run_id, row_index, attempt_no, a.hypothesis AS hypothesis, a.transform AS transform, a.confidence AS confidence, "
        "a.reasoning AS reasoning, a.row_after AS row_after FROM (SELECT *, unnest(attempts) AS a, "
        "unnest(range(1, len(attempts) + 1)) AS attempt_no FROM quarantine)",
    ),
)
def o4_diagnosis_history(spark: SparkSession, folder: str) -> DataFrame:
    rows = out.quarantine_rows(settled_orders(spark, folder), ORDERS)
    flat = rows.select("run_id", "row_index", F.posexplode("diagnosis_history").alias("pos", "a"))
    after = F.when(
        F.col("a.row_after").isNotNull(), F.concat_ws("|", *[F.col("a.row_after")[n] for n in FIELDS])
    )
    return flat.select(
        "run_id",
        "row_index",
        (F.col("pos") + 1).cast("bigint").alias("attempt_no"),
        "a.hypothesis",
        "a.transform",
        "a.confidence",
        "a.reasoning",
        after.alias("row_after"),
    )


def _audit_view(audit: DataFrame) -> DataFrame:
    return audit.withColumn("attempt_no", F.col("attempt_no").cast("bigint"))


@register("o5_audit_rows", statement(TABLES, "SELECT * FROM audit"))
def o5_audit_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _audit_view(audit_table(spark, folder))


@register(
    "o6_row_identifier",
    statement(FIRST_PASS, f"SELECT row_index, {oracle.IDENTIFIER} AS row_identifier FROM checked WHERE error_type IS NOT NULL"),
)
def o6_row_identifier(spark: SparkSession, folder: str) -> DataFrame:
    bad = checks.invalid_rows(checked_orders(spark, folder))
    return bad.select("row_index", out.row_identifier(ORDERS).alias("row_identifier"))


@register("o7_run_counts", statement(TABLES, "SELECT run_id, row_count, clean_first_pass, healed, quarantined FROM runs"))
def o7_run_counts(spark: SparkSession, folder: str) -> DataFrame:
    return out.run_counts(settled_orders(spark, folder), RULES).drop("error_types", "fixes_applied")


def _map_rows(runs: DataFrame, column: str) -> DataFrame:
    return runs.select("run_id", F.explode(column).alias("key", "n"))


@register("o8_error_types", statement(TABLES, "SELECT run_id, key, n FROM error_counts"))
def o8_error_types(spark: SparkSession, folder: str) -> DataFrame:
    return _map_rows(out.run_counts(settled_orders(spark, folder), RULES), "error_types")


@register("o9_fixes_applied", statement(TABLES, "SELECT run_id, key, n FROM fix_counts"))
def o9_fixes_applied(spark: SparkSession, folder: str) -> DataFrame:
    return _map_rows(out.run_counts(settled_orders(spark, folder), RULES), "fixes_applied")


@register("o10_time_to_heal")
def o10_time_to_heal(spark: SparkSession, folder: str) -> DataFrame:
    """Mean time to heal of a run over all messy orders; a measurement, so it has no fixed answer."""
    store = Store(spark, scratch_path(spark, "store"), ORDERS)
    run_batch(store, messy_orders(spark, folder).drop("run_id"), known_customers(spark, folder), 1, row_index="row_index")
    return analytics.heal_times(store.runs())


@register(
    "o11_run_status",
    statement(
        FIRST_PASS,
        "SELECT run_id, CASE WHEN count(*) FILTER (run_id % 3 = 0 AND mode = 5) > 0 THEN 'rejected_schema_drift' ELSE 'completed' END AS status, "
        "count(*) AS row_count, cast(count(*) FILTER (run_id % 3 = 0 AND mode = 5) > 0 AS bigint) AS unexpected_columns "
        "FROM norm GROUP BY run_id",
    ),
)
def o11_run_status(spark: SparkSession, folder: str) -> DataFrame:
    """End state of many runs at once: batches with an undeclared column are rejected as a whole."""
    ragged = ragged_orders(spark, folder)
    drift = checks.ragged_drift(ragged, ORDERS).groupBy("run_id").agg(F.count("*").alias("unexpected_columns"))
    sizes = ragged.groupBy("run_id").agg(F.count("*").alias("row_count"))
    rejected = F.col("unexpected_columns").isNotNull()
    return sizes.join(drift, "run_id", "left").select(
        "run_id",
        F.when(rejected, F.lit("rejected_schema_drift")).otherwise(F.lit("completed")).alias("status"),
        "row_count",
        F.coalesce("unexpected_columns", F.lit(0)).alias("unexpected_columns"),
    )


@register(
    "o12_reconciliation",
    statement(
        TABLES,
        "SELECT i.run_id, i.rows_in, r.clean_first_pass + r.healed + r.quarantined AS rows_out FROM "
        "(SELECT run_id, count(*) AS rows_in FROM norm GROUP BY run_id) i JOIN runs r ON i.run_id = r.run_id",
    ),
)
def o12_reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    """Rows in and rows out of every run; ``unreconciled`` keeps the runs where they differ."""
    sizes = messy_orders(spark, folder).groupBy("run_id").agg(F.count("*").alias("rows_in"))
    counts = out.run_counts(settled_orders(spark, folder), RULES)
    bad = out.unreconciled(counts, sizes).select("run_id", F.lit(1).alias("bad"))
    landed = F.col("clean_first_pass") + F.col("healed") + F.col("quarantined")
    both = sizes.join(counts, "run_id").join(bad, "run_id", "left_anti")
    return both.select("run_id", "rows_in", landed.alias("rows_out"))


@register(
    "o13_alert_rows",
    statement(
        TABLES,
        "SELECT r.run_id, r.quarantined AS quarantined_count, concat('Run ', r.run_id, ' quarantined ', r.quarantined, "
        "' row(s). Error types: {', e.listed, '}') AS text FROM runs r JOIN (SELECT run_id, string_agg(concat(key, ': ', n), ', ' ORDER BY key) "
        "AS listed FROM error_counts GROUP BY run_id) e ON r.run_id = e.run_id WHERE r.quarantined > 0",
    ),
)
def o13_alert_rows(spark: SparkSession, folder: str) -> DataFrame:
    return out.alert_rows(runs_table(spark, folder)).drop("error_types")


@register("o14_resolve_rows", statement(TABLES, "SELECT run_id, row_index, error_type, resolved FROM quarantine"))
def o14_resolve_rows(spark: SparkSession, folder: str) -> DataFrame:
    return quarantine_table(spark, folder).select("run_id", "row_index", "error_type", "resolved")


# --------------------------------------------------------------------------------- analytics

_RUN_COLUMNS = "run_id, row_count, clean_first_pass, healed, quarantined, status"
_QUARANTINE_COLUMNS = "run_id, row_index, error_type, attempt_count, resolved"


def _run_view(runs: DataFrame) -> DataFrame:
    return runs.select(*[c.strip() for c in _RUN_COLUMNS.split(",")])


def _quarantine_view(rows: DataFrame) -> DataFrame:
    return rows.withColumn("attempt_count", F.col("attempt_count").cast("bigint")).select(
        *[c.strip() for c in _QUARANTINE_COLUMNS.split(",")]
    )


def _over(name: str, sql: str, query: Query) -> None:
    register(name, statement(TABLES, sql))(query)


_over(
    "q1_runs_page",
    f"SELECT {_RUN_COLUMNS} FROM runs ORDER BY run_id DESC LIMIT 10 OFFSET 2",
    lambda s, d: _run_view(analytics.runs_page(runs_table(s, d), 10, 2)),
)
_over("q1_runs_total", "SELECT count(*) AS total FROM runs", lambda s, d: analytics.runs_total(runs_table(s, d)))
_over("q2_one_run", f"SELECT {_RUN_COLUMNS} FROM runs WHERE run_id = 2", lambda s, d: _run_view(analytics.one_run(runs_table(s, d), 2)))
_over(
    "q3_audit_trail",
    "SELECT * FROM audit WHERE run_id = 2 ORDER BY row_identifier, row_index, attempt_no",
    lambda s, d: _audit_view(analytics.audit_trail(audit_table(s, d), 2)),
)
_over(
    "q4_quarantine_page",
    f"SELECT {_QUARANTINE_COLUMNS} FROM quarantine WHERE run_id = 2 AND NOT resolved ORDER BY run_id DESC, row_index DESC LIMIT 50 OFFSET 10",
    lambda s, d: _quarantine_view(analytics.quarantine_page(quarantine_table(s, d), 2, False, 50, 10)),
)
_over(
    "q5_quarantine_count",
    "SELECT count(*) AS total FROM quarantine WHERE NOT resolved",
    lambda s, d: analytics.quarantine_count(quarantine_table(s, d), resolved=False),
)
_over(
    "q6_one_quarantine_row",
    f"SELECT {_QUARANTINE_COLUMNS} FROM quarantine WHERE run_id = 1 AND row_index = 41",
    lambda s, d: _quarantine_view(analytics.one_quarantine_row(quarantine_table(s, d), 1, 41)),
)
_TOTALS = (
    "SELECT count(*) AS total_runs, cast(sum(row_count) AS bigint) AS total_rows_processed, cast(sum(clean_first_pass) AS bigint) AS total_clean_first_pass, "
    "cast(sum(healed) AS bigint) AS total_healed, cast(sum(quarantined) AS bigint) AS total_quarantined FROM runs WHERE status = 'completed'"
)
_over(
    "q7_totals",
    _TOTALS,
    lambda s, d: analytics.totals(runs_table(s, d)).drop("overall_heal_rate", "auto_heal_rate"),
)
_over(
    "q8_heal_rates",
    f"SELECT cast(total_clean_first_pass + total_healed AS double) / total_rows_processed AS overall_heal_rate, "
    f"cast(total_healed AS double) / (total_healed + total_quarantined) AS auto_heal_rate FROM ({_TOTALS})",
    lambda s, d: analytics.totals(runs_table(s, d)).select("overall_heal_rate", "auto_heal_rate"),
)
_RATE = "cast(clean_first_pass + healed AS double) / cast(row_count AS double)"
_over(
    "q9_heal_rate_over_time",
    f"SELECT run_id, strftime(started_at, '%Y-%m-%dT%H:%M:%S') AS started_at, {_RATE} AS heal_rate, row_count FROM runs WHERE status = 'completed' ORDER BY run_id",
    lambda s, d: analytics.heal_rate_over_time(runs_table(s, d)),
)
_SUM = "SELECT c.key, cast(sum(c.n) AS bigint) AS total FROM {} c JOIN runs r ON c.run_id = r.run_id WHERE r.status = 'completed' GROUP BY c.key"
_over("q10_error_totals", _SUM.format("error_counts"), lambda s, d: analytics.map_totals(runs_table(s, d), "error_types"))
_over("q11_fix_totals", _SUM.format("fix_counts"), lambda s, d: analytics.map_totals(runs_table(s, d), "fixes_applied"))



def _kept_up(spark: SparkSession, folder: str) -> DataFrame:
    """Totals merged in two steps: the runs of before, then those that came since or were repeated with other counts."""
    runs = runs_table(spark, folder)
    last = runs.agg((F.max("run_id") / 2).cast("bigint")).first()[0] or 0
    again = (F.col("run_id") <= last) & (F.col("run_id") % 5 == 0)
    once = runs.withColumn("row_count", F.when(again, F.col("row_count") + 7).otherwise(F.col("row_count")))
    before = settle_table(running.run_sums(once.filter(F.col("run_id") <= last)), "totals")
    return running.merge_sums(
        before,
        running.run_sums(runs.filter((F.col("run_id") > last) | again)),
        taken_off=running.run_sums(once.filter(again)),
    )


_over(
    "q7_totals_kept_up",
    _TOTALS,
    lambda s, d: running.totals_of(_kept_up(s, d)).drop("overall_heal_rate", "auto_heal_rate"),
)
_over(
    "q10_errors_kept_up",
    _SUM.format("error_counts"),
    lambda s, d: running.map_totals_of(_kept_up(s, d), "error_types"),
)
_over(
    "q12_tab_counts",
    "SELECT count(*) FILTER (NOT resolved) AS unresolved, count(*) FILTER (resolved) AS resolved, count(*) AS all_rows FROM quarantine",
    lambda s, d: analytics.tab_counts(quarantine_table(s, d)),
)
_over(
    "q13_quarantine_by_type",
    f"SELECT error_type, count(*) AS n_rows, count(*) FILTER (NOT resolved) AS n_unresolved, {oracle.label('error_type')} AS label "
    "FROM quarantine GROUP BY error_type ORDER BY n_rows DESC, error_type",
    lambda s, d: analytics.quarantine_by_type(quarantine_table(s, d)),
)
_over(
    "q14_audit_patterns",
    """SELECT run_id, outcome, transform_chosen, count(*) AS n_rows, min_by(diagnosis_source, row_identifier) AS diagnosis_source,
  min_by(hypothesis, row_identifier) AS sample_hypothesis, min_by(reasoning, row_identifier) AS sample_reasoning
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, row_identifier ORDER BY row_index DESC, attempt_no DESC) AS nth FROM audit)
WHERE nth = 1 GROUP BY run_id, outcome, transform_chosen ORDER BY run_id, n_rows DESC, outcome, transform_chosen""",
    lambda s, d: analytics.audit_patterns(audit_table(s, d)),
)
_over(
    "q15_breakdown",
    f"SELECT key, {oracle.label('key')} AS label, total FROM ({_SUM.format('error_counts')}) ORDER BY total DESC, key LIMIT 8",
    lambda s, d: analytics.breakdown(analytics.map_totals(runs_table(s, d), "error_types")),
)
_TOP = "(SELECT run_id, arg_max(key, struct_pack(n := n, k := -rank)) AS key FROM (SELECT *, rank() OVER (PARTITION BY run_id ORDER BY key) AS rank FROM {}) GROUP BY run_id)"
_over(
    "q16_run_summary",
    f"""SELECT r.run_id, CASE status WHEN 'rejected_schema_drift' THEN 'Batch rejected: unexpected column(s) in the CSV (schema drift).'
  WHEN 'failed' THEN 'Run failed unexpectedly partway through.' WHEN 'running' THEN 'Still running...'
  ELSE CASE WHEN healed + quarantined = 0 THEN concat('All ', row_count, ' rows clean, no repairs needed.') ELSE
    concat(healed + quarantined, CASE WHEN healed + quarantined = 1 THEN ' row' ELSE ' rows' END, ' had errors (mostly ', lower({oracle.label('e.key')}), ')',
      CASE WHEN healed > 0 THEN concat(', ', healed, ' auto-fixed (mainly ', lower({oracle.label('f.key')}), ')') ELSE '' END,
      CASE WHEN quarantined > 0 THEN concat(', ', quarantined, ' quarantined') ELSE '' END, '.') END END AS summary
FROM runs r LEFT JOIN {_TOP.format('error_counts')} e ON r.run_id = e.run_id LEFT JOIN {_TOP.format('fix_counts')} f ON r.run_id = f.run_id""",
    lambda s, d: analytics.run_sentences(runs_table(s, d)),
)


@register("q17_labels", f"SELECT DISTINCT event_type, concat(event_type, '_id') AS raw, {oracle.label(chr(39).join(['concat(event_type, ', '_id', ')']))} AS label FROM events")
def q17_labels(spark: SparkSession, folder: str) -> DataFrame:
    kinds = table(spark, folder, "events").select("event_type").distinct()
    raw = F.concat("event_type", F.lit("_id"))
    return kinds.select("event_type", raw.alias("raw"), humanise(raw).alias("label"))


# Sixty-fourths are exact in both engines, and every range of the format occurs.
_MS = "(cast(floor(l_extendedprice) AS bigint) % 2500) / 64.0"


@register(
    "q18_heal_time_text",
    "SELECT l_orderkey, l_linenumber, CASE WHEN ms = 0 THEN '0 ms/row' "
    "WHEN ms < 1 THEN concat(format('{:.2f}', floor(ms * 100 + 0.5) / 100), ' ms/row') "
    "WHEN ms < 10 THEN concat(format('{:.1f}', floor(ms * 10 + 0.5) / 10), ' ms/row') "
    "ELSE concat(cast(floor(ms + 0.5) AS bigint), ' ms/row') END AS heal_time "
    f"FROM (SELECT l_orderkey, l_linenumber, cast({_MS} AS double) AS ms FROM lineitem)",
)
def q18_heal_time_text(spark: SparkSession, folder: str) -> DataFrame:
    ms = (F.floor("l_extendedprice").cast("bigint") % 2500).cast("double") / F.lit(64.0)
    items = table(spark, folder, "lineitem")
    return items.select("l_orderkey", "l_linenumber", heal_time_text(ms).alias("heal_time"))


_over(
    "q19_percent",
    f"SELECT run_id, concat('#', run_id) AS run, floor({_RATE} * 1000 + 0.5) / 10 AS heal_rate_pct, row_count FROM runs WHERE status = 'completed'",
    lambda s, d: analytics.heal_rate_chart(runs_table(s, d)),
)


# ---------------------------------------------------------------------------- fault injection


def clean_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as clean text rows with their key, before any fault."""
    return messy_orders(spark, folder).withColumn("k", F.col("row_index")).drop("run_id")


def _fault(name: str, sql: str, query: Callable[[DataFrame], DataFrame]) -> None:
    register(name, statement(_NORM, f"SELECT row_index AS k, {sql} FROM norm"))(
        lambda s, d: query(clean_orders(s, d))
    )


_fault("g1_schema_drift", "order_id, 'flagged for review' AS internal_notes", lambda o: faults.add_drift(o).select("k", "order_id", "internal_notes"))
_fault(
    "g2_type_mismatch",
    "CASE row_index % 3 WHEN 0 THEN 'fifty-two' WHEN 1 THEN 'N/A' ELSE '$49.99' END AS amount",
    lambda o: o.select("k", faults.bad_amount(F.col("k") % 3).alias("amount")),
)
_fault(
    "g3_date_swap",
    r"CASE WHEN regexp_full_match(order_date, '\d{4}-\d{2}-\d{2}') THEN concat(substr(order_date, 9, 2), '/', substr(order_date, 6, 2), '/', substr(order_date, 1, 4)) END AS order_date",
    lambda o: o.select("k", F.when(F.length("order_date") == 10, faults.swapped_date(F.col("order_date"))).alias("order_date")),
)
_fault(
    "g4_encoding",
    "concat(order_id, 'Ã¡Ã©Ã', chr(173), 'Ã³Ãº') AS order_id",
    lambda o: o.select("k", faults.mojibake(F.col("order_id")).alias("order_id")),
)
_fault(
    "g5_blank_field",
    ", ".join(f"CASE WHEN row_index % 6 = {i} THEN '' ELSE {c} END AS {c}" for i, c in enumerate(sorted(FIELDS))),
    lambda o: faults.blank_one(o, sorted(FIELDS), F.col("k") % 6).select("k", *sorted(FIELDS)),
)
_fault(
    "g6_unknown_key",
    "concat('CUST-', 9000 + row_index % 1000) AS customer_id",
    lambda o: o.select("k", faults.unknown_key("CUST-", F.col("k") % 1000).alias("customer_id")),
)


def _picked(salt: str, n: int) -> str:
    return f"(CAST('0x' || substr(md5(concat('7|{salt}|', row_index)), 1, 12) AS BIGINT) % {n})"


_MIX = [
    *FIRST_PASS,
    f"""hit AS (SELECT *, CASE WHEN cast({_picked('hit', 1_000_000)} AS double) / 1000000 < 0.3 THEN
  [{', '.join(f"'{m}'" for m in faults.MODES)}][{_picked('mode', 6)} + 1] END AS injected_mode FROM checked WHERE error_type IS NULL)""",
]


@register(
    "g7_inject_mix",
    statement(
        _MIX,
        f"""SELECT row_index, injected_mode,
  CASE WHEN injected_mode = 'schema_drift' THEN 'flagged for review' END AS internal_notes,
  CASE WHEN injected_mode = 'null_required_field' AND {_picked('blank', 6)} = 0 THEN ''
       WHEN injected_mode = 'type_mismatch' THEN ['fifty-two', 'N/A', '$49.99'][{_picked('amount', 3)} + 1] ELSE amount END AS amount,
  CASE WHEN injected_mode = 'null_required_field' AND {_picked('blank', 6)} = 2 THEN ''
       WHEN injected_mode = 'invalid_foreign_key' THEN concat('CUST-', 9000 + {_picked('unknown', 1000)}) ELSE customer_id END AS customer_id,
  CASE WHEN injected_mode = 'null_required_field' AND {_picked('blank', 6)} = 3 THEN ''
       WHEN injected_mode = 'date_format_swap' THEN strftime(cast(order_date AS date), '%d/%m/%Y') ELSE order_date END AS order_date,
  CASE WHEN injected_mode = 'null_required_field' AND {_picked('blank', 6)} = 4 THEN ''
       WHEN injected_mode = 'encoding_issue' THEN concat(order_id, 'Ã¡Ã©Ã', chr(173), 'Ã³Ãº') ELSE order_id END AS order_id
FROM hit""",
    ),
)
def g7_inject_mix(spark: SparkSession, folder: str) -> DataFrame:
    """A seeded mix of faults over valid rows, with its labels."""
    valid = checks.valid_rows(checked_orders(spark, folder)).select("run_id", "row_index", *FIELDS)
    faulty = faults.inject(valid, ORDERS, "row_index", rate=0.3, seed=7)
    return faulty.select("row_index", "injected_mode", "internal_notes", "amount", "customer_id", "order_date", "order_id")
