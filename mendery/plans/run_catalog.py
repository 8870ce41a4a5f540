"""More registered queries: files with headers of their own, the life of a run, and the extension points."""

from __future__ import annotations

import hashlib
import json
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendery.contract import ORDERS, Contract, Remedy, built_in_transforms
from mendery.operators import checks
from mendery.operators.external import call_service, external_diagnoser, parse_response, system_prompt, user_prompt
from mendery.operators.repair import repair_rows
from mendery.plans import oracle, outcomes
from mendery.plans.analytics import mean_heal_time
from mendery.plans.catalog import _QUARANTINE_COLUMNS, _SINGLE, FIELDS, QUERIES, _quarantine_view, checked_orders, register, settled_orders, stored_orders
from mendery.plans.oracle import FIRST_PASS, TABLES, statement
from mendery.plans.pages import mark_of, seek_quarantine
from mendery.plans.run import BatchTooLarge, RunOptions, run_batch, run_files
from mendery.plans.sample_orders import known_customers, messy_orders, raw_orders, table
from mendery.session import scratch_path
from mendery.sources.csv import read_csv, write_csv
from mendery.sources.tables import Store
from mendery.streaming.arrivals import process_arrivals

_NORM = FIRST_PASS[:3]

# ------------------------------------------------------------------------------------- files


def write_ordered_csv(frame: DataFrame, path: str, header: list[str], mode: str = "error") -> None:
    """CSV files whose columns keep the order they have, unlike the sorted export."""
    frame.toDF(*header).write.mode(mode).options(header="true", quote='"', escape='"', emptyValue="").csv(path)


def write_lines(frame: DataFrame, path: str, header: str) -> None:
    """Text files from a column ``line``, each with the header line first."""

    def with_header(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"line": [header]})
        yield from batches

    frame.select("line").mapInArrow(with_header, "line string").write.text(path)


def _write_long_lines(raw: DataFrame, path: str) -> None:
    """Orders as lines with two fields more than their header."""
    options = {"quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    line = F.concat(F.to_csv(F.struct("row_index", *FIELDS), options), F.lit(",overflow,more"))
    write_lines(raw.select(line.alias("line")), path, ",".join(["row_index", *FIELDS]))


def _untidy_folder(spark: SparkSession, folder: str) -> list[str]:
    """Messy orders as files of three kinds: declared order, reversed order, and over-long rows."""
    raw = raw_orders(spark, folder).select("row_index", *FIELDS)
    root = scratch_path(spark, "csv-folder")
    reverse = list(reversed(["row_index", *FIELDS]))
    write_ordered_csv(raw.filter("row_index % 3 = 0"), f"{root}/a", ["row_index", *[f" {n.upper()}" for n in FIELDS]])
    write_ordered_csv(raw.filter("row_index % 3 = 1").select(*reverse), f"{root}/b", reverse)
    _write_long_lines(raw.filter("row_index % 3 = 2"), f"{root}/c")
    return [f"{root}/{x}" for x in "abc"]


@register("s1_csv_folder", statement(_NORM, f"SELECT row_index, {', '.join(FIELDS)} FROM norm"))
def s1_csv_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Files with different column orders, one kind with over-long rows, read as one table by name."""
    rows = read_csv(spark, _untidy_folder(spark, folder))
    return rows.select(F.col("row_index").cast("bigint").alias("row_index"), *FIELDS)


@register("s6_overflow_fields", statement(_NORM, f"SELECT row_index, {', '.join(FIELDS)} FROM norm"))
def s6_overflow_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with more fields than their header: the rest is dropped, the columns stay the declared ones."""
    path = scratch_path(spark, "long-lines")
    _write_long_lines(raw_orders(spark, folder), path)
    rows = read_csv(spark, path)
    return rows.select(F.col("row_index").cast("bigint").alias("row_index"), *[c for c in rows.columns if c != "row_index"])


_NOTES = "concat('line one of ', {k}, chr(10), '\"quoted\", with comma', chr(10))"


@register(
    "s2_landing_scan",
    "SELECT o_orderkey AS key, trim(CASE WHEN o_orderkey % 4 = 0 THEN " + _NOTES.format(k="o_orderkey") + " ELSE o_orderstatus END, concat(chr(10), ' ')) AS note FROM orders",
)
def s2_landing_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A landing folder of uploads, some with quoted line breaks."""
    orders = table(spark, folder, "orders")
    root = scratch_path(spark, "landing")
    key = F.col("o_orderkey").alias("key")
    write_csv(f"{root}/plain", orders.filter("o_orderkey % 4 <> 0").select(key, F.col("o_orderstatus").alias("note")))
    broken = orders.filter("o_orderkey % 4 = 0").select(key, F.expr(_NOTES.format(k="o_orderkey").replace('"', '\\"')).alias("note"))
    write_csv(f"{root}/breaks", broken)
    rows = read_csv(spark, [f"{root}/plain", f"{root}/breaks"])
    return rows.select(F.col("key").cast("bigint").alias("key"), "note")


@register(
    "s7_file_order",
    "SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderkey % 7 <> 0, o_orderkey) - 1 AS row_index FROM orders",
)
def s7_file_order(spark: SparkSession, folder: str) -> DataFrame:
    """A small file named before a large one: positions follow files by path, then lines."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"))
    root = scratch_path(spark, "file-order")
    write_csv(f"{root}/1-small", orders.filter("key % 7 = 0").orderBy("key"))
    write_csv(f"{root}/2-large", orders.filter("key % 7 <> 0").orderBy("key"))
    rows = read_csv(spark, [f"{root}/2-large", f"{root}/1-small"], row_index="row_index")
    return rows.select(F.col("key").cast("bigint").alias("key"), "row_index")


def _write_drifted(spark: SparkSession, folder: str, good: str, drifted: str) -> None:
    """Half of the orders as files of the contract, the other half with a column more."""
    raw = raw_orders(spark, folder)
    write_ordered_csv(raw.filter("row_index % 2 = 0").select(*FIELDS), good, list(FIELDS), "append")
    noted = raw.filter("row_index % 2 = 1").select(*reversed(FIELDS), F.lit("flagged").alias("note"))
    write_ordered_csv(noted, drifted, [*reversed(FIELDS), " Internal_Notes"], "append")


def _run_states(store: Store) -> DataFrame:
    return store.runs().select(
        "status", "row_count", F.coalesce(F.col("error_types")["schema_drift"], F.lit(0)).cast("bigint").alias("unexpected_columns")
    )


@register("v1_file_drift", "SELECT 'rejected_schema_drift' AS status, count(*) AS row_count, 1 AS unexpected_columns FROM orders")
def v1_file_drift(spark: SparkSession, folder: str) -> DataFrame:
    """One drifted file among good ones: the batch is rejected before any row work."""
    store = Store(spark, scratch_path(spark, "store"), ORDERS)
    root = scratch_path(spark, "drifted")
    _write_drifted(spark, folder, f"{root}/a", f"{root}/b")
    run_files(store, [f"{root}/a", f"{root}/b"], known_customers(spark, folder), 1)
    return _run_states(store)


@register(
    "t1_drifted_arrival",
    "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'completed' ELSE 'rejected_schema_drift' END AS status, count(*) AS n_rows FROM orders GROUP BY ALL",
)
def t1_drifted_arrival(spark: SparkSession, folder: str) -> DataFrame:
    """Every arriving file is a run of its own, so a drifted one rejects only itself."""
    landing = scratch_path(spark, "arrivals")
    _write_drifted(spark, folder, landing, landing)
    store = Store(spark, scratch_path(spark, "store"), ORDERS)
    stream = process_arrivals(store, landing, known_customers(spark, folder), scratch_path(spark, "stream"), max_files=1)
    stream.awaitTermination()
    return store.runs().groupBy("status").agg(F.sum("row_count").alias("n_rows"))


# -------------------------------------------------------------------------------- hard values

# Texts that are easy to get wrong, with the kind of error that each must give (None: acceptable).
HARD_AMOUNTS = {
    "1e2": None, ".5": None, "5.": None, "+5": None, "1_000": None, "49.990": None, "0005.00": None, "9999999999.99": None,
    "49.123": "decimal_max_places", "1e-3": "decimal_max_places", "12345678901": "decimal_whole_digits",
    "1234567890123": "decimal_max_digits", "0": "greater_than", "0.00": "greater_than", "-5": "greater_than", "NaN": "finite_number",
    "-Infinity": "finite_number", "1,000": "decimal_parsing", "": "decimal_parsing", "$5": "decimal_parsing", ".": "decimal_parsing",
}
HARD_DATES = {
    "2026-01-01": None, "2026-01-01T00:00:00": None, "2026-01-01 00:00": None, "2026-01-01T00:00:00Z": None, "1767225600": None, "0": None,
    "2024-02-29": None, "2026-02-29": "date_from_datetime_parsing", "2026-1-1": "date_from_datetime_parsing",
    "2026/01/01": "date_from_datetime_parsing", "20260701": "date_from_datetime_inexact", "1767225601": "date_from_datetime_inexact",
    "2026-07-01T14:30:00": "date_from_datetime_inexact", "2026-07-01 garbage": "date_from_datetime_parsing", "2026": "date_from_datetime_inexact",
    "": "date_from_datetime_parsing", "0000-01-01": "date_from_datetime_parsing",
}


def _hard_query(name: str, field: str, cases: dict[str, str | None]) -> None:
    def sql(values) -> str:
        return " ".join(f"WHEN {i} THEN {'NULL' if v is None else chr(39) + v + chr(39)}" for i, v in enumerate(values))

    n = len(cases)
    texts = f"CASE o_orderkey % {n} {sql(cases)} END"

    @register(name, f"SELECT o_orderkey AS k, {texts} AS value, CASE o_orderkey % {n} {sql(cases.values())} END AS kind FROM orders")
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), F.expr(texts).alias("value"))
        return rows.withColumn("kind", ORDERS[field].failure(F.col("value")))


_hard_query("v6_hard_amounts", "amount", HARD_AMOUNTS)
_hard_query("v5_hard_dates", "order_date", HARD_DATES)


# -------------------------------------------------------------------------------- life of a run


@register("s10_row_cap", "SELECT 'failed' AS status, count(*) AS row_count, 0 AS unexpected_columns FROM orders")
def s10_row_cap(spark: SparkSession, folder: str) -> DataFrame:
    """A batch over the cap: a failed run that knows its size."""
    store = Store(spark, scratch_path(spark, "store"), ORDERS)
    rows = messy_orders(spark, folder).drop("run_id")
    try:
        run_batch(store, rows, known_customers(spark, folder), 1, RunOptions(max_batch_rows=100), "row_index")
    except BatchTooLarge:
        pass
    return _run_states(store)


@register(
    "o11_failed_runs",
    "SELECT 1 AS run_id, 'failed' AS status, 0 AS row_count UNION ALL SELECT 2, 'failed', count(*) FROM orders",
)
def o11_failed_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Run 1 cannot read its file; run 2 reads its rows and fails later, on keys that are no table."""
    store = Store(spark, scratch_path(spark, "store"), ORDERS)
    known = known_customers(spark, folder)
    missing = scratch_path(spark, "missing")
    rows = messy_orders(spark, folder).drop("run_id")
    broken = known.select(F.raise_error(F.concat(F.lit("no such key: "), F.col("customer_id"))).cast("string").alias("customer_id"))
    for attempt in (
        lambda: run_files(store, missing, known, 1),
        lambda: run_batch(store, rows, broken, 2, row_index="row_index"),
    ):
        try:
            attempt()
        except Exception:  # noqa: BLE001  the failure is the subject
            pass
    return store.runs().select("run_id", "status", "row_count")


def _failing_sink(alert) -> None:
    raise ConnectionError("nobody listens")


@register(
    "u3_alert_table",
    statement(
        _SINGLE,
        "SELECT 1 AS run_id, n AS quarantined_count, concat('Run 1 quarantined ', n, ' row(s). Error types: {', listed, '}') AS text FROM "
        "(SELECT count(*) AS n FROM settled WHERE disposition = 'quarantined'), "
        "(SELECT string_agg(concat(key, ': ', c), ', ' ORDER BY key) AS listed FROM (SELECT error_type AS key, count(*) AS c FROM settled "
        "WHERE error_type IS NOT NULL GROUP BY error_type))",
    ),
)
def u3_alert_table(spark: SparkSession, folder: str) -> DataFrame:
    """The alert row is written although its only sink fails."""
    store = Store(spark, scratch_path(spark, "store"), ORDERS)
    rows = messy_orders(spark, folder).drop("run_id")
    run_batch(store, rows, known_customers(spark, folder), 1, RunOptions(alert_sinks=[_failing_sink]), "row_index")
    return store.alerts().select("run_id", "quarantined_count", "text")


@register(
    "o10_mean_heal_time",
    statement(
        TABLES,
        "SELECT run_id, coalesce(avg(cast(row_index % 256 AS double) / 64) FILTER (healed), -1) AS avg_time_to_heal_ms FROM settled GROUP BY run_id",
    ),
)
def o10_mean_heal_time(spark: SparkSession, folder: str) -> DataFrame:
    """Mean over given times per row; NULL (shown as -1) for a run that healed nothing."""
    timed = settled_orders(spark, folder).withColumn("heal_ms", (F.col("row_index") % 256).cast("double") / 64)
    return mean_heal_time(timed).select("run_id", F.coalesce("avg_time_to_heal_ms", F.lit(-1.0)).alias("avg_time_to_heal_ms"))


# --------------------------------------------------------------------------- external diagnosis


def answering_client():
    """A client whose answer is a pure function of the prompt, so that SQL can restate it."""

    def call(system: str, user: str) -> str:
        digit = int(hashlib.md5(user.encode()).hexdigest()[0], 16)
        if digit < 4:
            return json.dumps({"hypothesis": "asked", "transform": "no_fix", "confidence": 0.5, "reasoning": "r"})
        if digit < 8:
            return json.dumps({"hypothesis": "asked", "transform": "coerce_amount", "confidence": 0.25, "reasoning": "r"})
        if digit < 12:
            return "not json at all"
        raise TimeoutError("no answer")

    return call


def _errors(value, kind) -> Column:
    return ORDERS.errors(value, kind, F.col("error_type"))


def _prompts(spark: SparkSession, folder: str) -> DataFrame:
    bad = checks.invalid_rows(checked_orders(spark, folder))
    prompt = user_prompt(F.struct(*FIELDS), F.col("error_type"), _errors(checks.value_of, checks.kind_of))
    return bad.select("run_id", "row_index", prompt.alias("prompt"))


_ERROR_LIST = ", ".join(
    f"CASE WHEN k_{f} IS NOT NULL THEN {{'field': '{f}', 'msg': {oracle.message(f, 'k_' + f)}, 'type': k_{f}}} END" for f in FIELDS
)
_PROMPTS = [
    *FIRST_PASS,
    f"""prompts AS (SELECT row_index, concat('Row data: ', to_json({{{', '.join(f"'{f}': {f}" for f in FIELDS)}}}),
  chr(10), 'Error type: ', error_type, chr(10), 'Validation errors: ', to_json(CASE WHEN error_type = 'invalid_foreign_key'
  THEN [{{'field': 'customer_id', 'msg': concat('Unknown customer_id: ', customer_id), 'type': 'referential_integrity'}}]
  ELSE list_filter([{_ERROR_LIST}], lambda x: x IS NOT NULL) END)) AS prompt FROM checked WHERE error_type IS NOT NULL)""",
    "asked AS (SELECT row_index, CAST('0x' || substr(md5(prompt), 1, 1) AS INTEGER) AS digit FROM prompts)",
]


@register("d7_prompt", statement(_PROMPTS, "SELECT row_index, prompt FROM prompts"))
def d7_prompt(spark: SparkSession, folder: str) -> DataFrame:
    return _prompts(spark, folder).select("row_index", "prompt")


@register(
    "d8_external_answers",
    statement(
        _PROMPTS,
        "SELECT row_index, CASE WHEN digit < 8 THEN 'json' WHEN digit < 12 THEN 'not json at all' ELSE 'none' END AS answer, digit >= 12 AS failed FROM asked",
    ),
)
def d8_external_answers(spark: SparkSession, folder: str) -> DataFrame:
    """One call per invalid row, eight tasks at most; a failing call is a value."""
    ask = call_service(answering_client, system_prompt(ORDERS, built_in_transforms(ORDERS)))
    asked = _prompts(spark, folder).repartition(8).select("row_index", ask(F.col("prompt")).alias("c"))
    answer = F.when(F.col("c.response").startswith("{"), F.lit("json")).otherwise(F.coalesce("c.response", F.lit("none")))
    return asked.select("row_index", answer.alias("answer"), F.col("c.error").isNotNull().alias("failed"))


@register(
    "u2_client_plug_in",
    statement(
        _PROMPTS,
        "SELECT CASE WHEN digit < 4 THEN 'no fix' WHEN digit < 8 THEN 'fix' WHEN digit < 12 THEN 'refused' ELSE 'failed' END AS outcome, count(*) AS n_rows FROM asked GROUP BY ALL",
    ),
)
def u2_client_plug_in(spark: SparkSession, folder: str) -> DataFrame:
    """What became of the calls of a client given by the user."""
    ids = built_in_transforms(ORDERS).ids
    ask = call_service(answering_client, system_prompt(ORDERS, built_in_transforms(ORDERS)))
    asked = _prompts(spark, folder).repartition(8).select(ask(F.col("prompt")).alias("c"))
    parsed = asked.withColumn("p", parse_response(F.col("c.response"), ids))
    outcome = (
        F.when(F.col("c.error").isNotNull(), F.lit("failed"))
        .when(F.col("p.error").isNotNull(), F.lit("refused"))
        .when(F.col("p.diagnosis.transform").isNull(), F.lit("no fix"))
        .otherwise(F.lit("fix"))
    )
    return parsed.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n_rows"))


_FIRST_DIAGNOSIS = [*_PROMPTS, oracle.start_stage("checked"), *oracle.diagnosis_stages("s0", "1")]


@register(
    "d6_mode_choice",
    statement(
        _FIRST_DIAGNOSIS,
        "SELECT d.row_index, CASE WHEN digit < 8 THEN 'llm' ELSE 'heuristic' END AS source, CASE WHEN digit < 8 THEN 'asked' ELSE d.hypothesis END AS hypothesis, "
        "CASE WHEN digit < 4 THEN NULL WHEN digit < 8 THEN 'coerce_amount' ELSE d.transform END AS transform, "
        "CASE WHEN digit < 4 THEN 0.5 WHEN digit < 8 THEN 0.25 ELSE d.confidence END AS confidence FROM d1 d JOIN asked a ON d.row_index = a.row_index",
    ),
)
def d6_mode_choice(spark: SparkSession, folder: str) -> DataFrame:
    """The service's diagnosis where it gave a valid one, the heuristic's otherwise."""
    bad = checks.invalid_rows(checked_orders(spark, folder))
    diagnoser = external_diagnoser(answering_client, ORDERS, built_in_transforms(ORDERS))
    repaired = repair_rows(bad, ORDERS, known_customers(spark, folder), max_attempts=1, diagnoser=diagnoser)
    first = F.col("attempts")[0]
    return repaired.select("row_index", *[first[c].alias(c) for c in ("source", "hypothesis", "transform", "confidence")])


# ------------------------------------------------------------------------------ pages by continuation


@register(
    "q4_next_page",
    statement(TABLES, f"SELECT {_QUARANTINE_COLUMNS} FROM quarantine WHERE NOT resolved ORDER BY run_id DESC, row_index DESC LIMIT 300 OFFSET 500"),
)
def q4_next_page(spark: SparkSession, folder: str) -> DataFrame:
    """Open rows of the quarantine: the page after the first one, found from its last row."""
    store = stored_orders(spark, folder)
    first = seek_quarantine(store, resolved=False, limit=500)
    mark = mark_of(first)
    return _quarantine_view(seek_quarantine(store, resolved=False, limit=300, after=mark) if mark else first)


# ------------------------------------------------------------------------------ custom transforms


def with_status_default() -> tuple[Contract, outcomes.Rules]:
    """The orders contract with a transform of the user's own: an unknown status becomes ``pending``."""
    remedy = Remedy("default_status", 0.5, "status is not known here", "The default is {}.")
    fields = tuple(replace(f, remedy=remedy) if f.name == "status" else f for f in ORDERS.fields)
    contract = replace(ORDERS, fields=fields)
    registry = built_in_transforms(contract).extended(
        default_status=lambda value, name: F.when((name == "status") & (value == "unknown"), F.lit("pending"))
    )
    return contract, outcomes.Rules(contract, registry)


@register(
    "u1_custom_transform",
    statement(
        FIRST_PASS,
        "SELECT row_index, key_known AS healed, CASE WHEN key_known THEN 'pending' ELSE 'pending' END AS status, 'default_status' AS transform "
        "FROM checked WHERE mode = 12",
    ),
)
def u1_custom_transform(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with an unknown status, repaired by a registered transform; unknown customers stay out."""
    contract, rules = with_status_default()
    bad = checks.invalid_rows(checked_orders(spark, folder)).filter("status = 'unknown'")
    repaired = repair_rows(bad, contract, known_customers(spark, folder), rules.transforms, rules.max_attempts)
    return repaired.select("row_index", "healed", F.col("final.status").alias("status"), F.col("attempts")[0]["transform"].alias("transform"))


def with_customer_lookup() -> tuple[Contract, outcomes.Rules]:
    """The orders contract with a transform that makes a customer id of a bare number."""
    remedy = Remedy("complete_customer", 0.6, "customer_id is a bare number", "Completing it gives {}.")
    fields = tuple(replace(f, remedy=remedy) if f.name == "customer_id" else f for f in ORDERS.fields)
    contract = replace(ORDERS, fields=fields)
    complete = lambda value, name: F.when((name == "customer_id") & value.rlike("^[0-9]+$"), F.concat(F.lit("CUST-"), F.lpad(value, 12, "0")))
    return contract, outcomes.Rules(contract, built_in_transforms(contract).extended(complete_customer=complete))


@register(
    "u1_key_repair",
    statement(
        _NORM,
        "SELECT row_index, k.customer_id IS NOT NULL AS healed, CASE WHEN k.customer_id IS NULL THEN 'no_fix' END AS end_reason, "
        "CASE WHEN k.customer_id IS NULL THEN 2 ELSE 1 END AS n_attempts, "
        "CASE WHEN k.customer_id IS NULL THEN 'customer_id does not exist in the known-customers reference set' ELSE 'customer_id is a bare number' END AS hypothesis, "
        "n.customer_id AS final_customer_id FROM norm n LEFT JOIN known k ON k.customer_id = n.customer_id WHERE mode >= 22",
    ),
)
def u1_key_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Customer ids completed by a custom transform: one that turns out unknown is diagnosed again in the loop."""
    contract, rules = with_customer_lookup()
    known = known_customers(spark, folder)
    rows = messy_orders(spark, folder).filter("mode >= 22")
    checked = checks.first_pass(rows.withColumn("customer_id", F.substring("customer_id", 6, 12)), contract, known)
    repaired = repair_rows(checks.invalid_rows(checked), contract, known, rules.transforms, rules.max_attempts)
    last = F.element_at("attempts", -1)
    return repaired.select(
        "row_index", "healed", "end_reason", F.size("attempts").alias("n_attempts"), last["hypothesis"].alias("hypothesis"), F.col("final.customer_id").alias("final_customer_id")
    )


_IDS = ("coerce_amount", "reformat_date", "fix_encoding")


@register(
    "r4_registry",
    statement(
        _NORM,
        " UNION ALL ".join(
            f"SELECT row_index, '{t}' AS transform, {oracle.apply_transform('order_id', 'order_id', chr(39) + t + chr(39))} AS order_id, "
            f"{oracle.apply_transform('amount', 'amount', chr(39) + t + chr(39))} AS amount FROM norm"
            for t in (*_IDS, "drop_row")
        ),
    ),
)
def r4_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Dispatch on the transform id; an id that is not registered repairs nothing."""
    registry = built_in_transforms(ORDERS)
    names = F.explode(F.array(*[F.lit(t) for t in (*_IDS, "drop_row")])).alias("transform")
    rows = messy_orders(spark, folder).select("row_index", "order_id", "amount", names)
    return rows.select(
        "row_index",
        "transform",
        *[registry.apply(F.col("transform"), F.col(n), F.lit(n)).alias(n) for n in ("order_id", "amount")],
    )
