"""DuckDB statements that restate the registered queries, for checking them.

Every statement starts from the recipe that its Spark query starts from and covers the whole tables. The
repair loop is written out as one group of common table expressions per attempt.
"""

from __future__ import annotations

from typing import NamedTuple

from mendery.plans.sample_orders import EXISTING_SQL, KNOWN_SQL, MESSY_SQL

# Fixed values of the orders contract, written out again on purpose: a wrong text in the engine must not be
# wrong on both sides.
FIELDS = ("order_id", "customer_id", "order_date", "amount", "currency", "status")
CURRENCIES = ("USD", "EUR", "GBP", "CAD", "AUD", "JPY")
STATUSES = ("pending", "processing", "shipped", "delivered", "cancelled", "refunded")
PATTERNS = {"order_id": "ORD-[A-Za-z0-9]{6,}", "customer_id": "CUST-[A-Za-z0-9]{4,}"}
MESSAGES = {
    "order_id": {"value_error": "Value error, order_id must match ^ORD-[A-Za-z0-9]{6,}$"},
    "customer_id": {"value_error": "Value error, customer_id must match ^CUST-[A-Za-z0-9]{4,}$"},
    "order_date": {
        "date_from_datetime_parsing": "Input should be a valid date or datetime",
        "date_from_datetime_inexact": "Datetimes provided to dates should have zero time - e.g. be exact dates",
    },
    "amount": {
        "decimal_parsing": "Input should be a valid decimal",
        "finite_number": "Input should be a finite number",
        "decimal_max_digits": "Decimal input should have no more than 12 digits in total",
        "decimal_max_places": "Decimal input should have no more than 2 decimal places",
        "decimal_whole_digits": "Decimal input should have no more than 10 digits before the decimal point",
        "greater_than": "Input should be greater than 0",
    },
    "currency": {"enum": "Input should be 'USD', 'EUR', 'GBP', 'CAD', 'AUD' or 'JPY'"},
    "status": {"enum": "Input should be 'pending', 'processing', 'shipped', 'delivered', 'cancelled' or 'refunded'"},
}


class Remedied(NamedTuple):
    """Field, transform, confidence, hypothesis, and the reasoning before and after the repaired value."""

    name: str
    transform: str
    confidence: float
    hypothesis: str
    before: str
    after: str


REMEDIED = (
    Remedied("order_id", "fix_encoding", 0.85, "order_id has a trailing non-ASCII/mojibake artifact", "Stripping the trailing artifact recovers a valid value: ", "."),
    Remedied("customer_id", "fix_encoding", 0.85, "customer_id has a trailing non-ASCII/mojibake artifact", "Stripping the trailing artifact recovers a valid value: ", "."),
    Remedied("order_date", "reformat_date", 0.9, "order_date is a real calendar date in a non-ISO format", "Reparsing recovers a valid ISO date: ", "."),
    Remedied("amount", "coerce_amount", 0.85, "amount contains currency symbols or non-numeric formatting noise", "Stripping non-numeric characters yields a valid positive amount: ", "."),
)
_BLANKS = "concat(chr(9), chr(10), chr(13), ' ')"


def _strings(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def kind(field: str, x: str) -> str:
    """Error kind of the text ``x`` in a field."""
    if field in PATTERNS:
        rest = f"WHEN NOT regexp_full_match({x}, '{PATTERNS[field]}') THEN 'value_error'"
    elif field == "order_date":
        rest = (
            rf"WHEN regexp_full_match({x}, '\d{{4}}-\d{{2}}-\d{{2}}') AND try_cast({x} AS date) IS NOT NULL THEN NULL "
            rf"WHEN regexp_full_match({x}, '\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}') AND substr({x}, 12) <> '00:00:00' "
            "THEN 'date_from_datetime_inexact' ELSE 'date_from_datetime_parsing'"
        )
    elif field == "amount":
        rest = (
            rf"WHEN regexp_full_match({x}, '[0-9]{{1,10}}(\.[0-9]{{1,2}})?') AND regexp_matches({x}, '[1-9]') THEN NULL "
            rf"WHEN regexp_full_match({x}, '[0-9]{{1,9}}\.[0-9]{{3}}') THEN 'decimal_max_places' ELSE 'decimal_parsing'"
        )
    else:
        listed = CURRENCIES if field == "currency" else STATUSES
        rest = f"WHEN {x} NOT IN ({_strings(listed)}) THEN 'enum'"
    return f"CASE WHEN {x} IS NULL THEN 'missing' {rest} END"


def message(field: str, k: str) -> str:
    texts = {"missing": "Field required", **MESSAGES[field]}
    whens = " ".join("WHEN '{}' THEN '{}'".format(a, b.replace("'", "''")) for a, b in texts.items())
    return f"CASE {k} {whens} END"


def first_kind(prefix: str = "k_") -> str:
    whens = " ".join(f"WHEN {prefix}{f} IS NOT NULL THEN 'invalid_{f}'" for f in FIELDS)
    return f"CASE {whens} END"


def coerce(x: str) -> str:
    c = rf"regexp_replace({x}, '[$€£¥,\s]', '', 'g')"
    return (
        rf"CASE WHEN {c} <> {x} AND regexp_full_match({c}, '\+?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') "
        rf"AND regexp_matches(regexp_replace({c}, '[eE].*', ''), '[1-9]') THEN {c} END"
    )


def reformat(x: str) -> str:
    month = "[A-Za-z]+"
    layouts = [
        (r"\d{1,2}/\d{1,2}/\d{4}", ["%d/%m/%Y", "%m/%d/%Y"]),
        (r"\d{1,2}-\d{1,2}-\d{4}", ["%d-%m-%Y"]),
        (r"\d{4}/\d{1,2}/\d{1,2}", ["%Y/%m/%d"]),
        (r"\d{1,2}/\d{1,2}/\d{2}", ["%d/%m/%y", "%m/%d/%y"]),
        (r"\d{1,2}\.\d{1,2}\.\d{4}", ["%d.%m.%Y"]),
        (r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}", ["%Y-%m-%dT%H:%M:%S"]),
        (month + r" \d{1,2}, \d{4}", ["%B %d, %Y", "%b %d, %Y"]),
        (r"\d{1,2} " + month + r" \d{4}", ["%d %B %Y", "%d %b %Y"]),
    ]
    whens = " ".join(
        f"WHEN regexp_full_match({x}, '{p}') THEN try_strptime({x}, [{_strings(f)}])" for p, f in layouts
    )
    return f"strftime(CASE {whens} END, '%Y-%m-%d')"


def fix(field: str, x: str) -> str:
    if field not in PATTERNS:
        return "CAST(NULL AS VARCHAR)"
    c = f"regexp_replace({x}, '[^A-Za-z0-9]+$', '')"
    return f"CASE WHEN {c} <> {x} AND regexp_full_match({c}, '{PATTERNS[field]}') THEN {c} END"


def apply_transform(field: str, x: str, transform: str = "transform") -> str:
    return (
        f"CASE {transform} WHEN 'coerce_amount' THEN {coerce(x)} WHEN 'reformat_date' THEN {reformat(x)} "
        f"WHEN 'fix_encoding' THEN {fix(field, x)} END"
    )


# ------------------------------------------------------------------------------------- stages

_MESSY = f"messy AS ({MESSY_SQL.format(orders='orders')})"
_KNOWN = f"known AS (SELECT DISTINCT customer_id FROM ({KNOWN_SQL.format(customer='customer')}))"
_HELD = f"held AS (SELECT DISTINCT order_id FROM ({EXISTING_SQL.format(orders='orders')}))"
_NORM = "norm AS (SELECT run_id, row_index, mode, {} FROM messy)".format(
    ", ".join(f"trim({f}, {_BLANKS}) AS {f}" for f in FIELDS)
)
_JUDGED = "judged AS (SELECT *, {} FROM norm)".format(", ".join(f"{kind(f, f)} AS k_{f}" for f in FIELDS))
_CHECKED = f"""checked AS (
  SELECT *, CASE WHEN contract_type IS NOT NULL THEN contract_type
                 WHEN NOT key_known THEN 'invalid_foreign_key' END AS error_type
  FROM (SELECT *, {first_kind()} AS contract_type,
          customer_id IN (SELECT customer_id FROM known) AS key_known,
          coalesce({fix('customer_id', 'customer_id')} IN (SELECT customer_id FROM known), false) AS stripped_known
        FROM judged))"""

FIRST_PASS = [_MESSY, _KNOWN, _NORM, _JUDGED, _CHECKED]


def _failing() -> str:
    items = [f"CASE WHEN k_{f} IS NOT NULL THEN '{f}' END" for f in FIELDS]
    items.append("CASE WHEN etype = 'invalid_foreign_key' THEN 'customer_id' END")
    items.append("CASE WHEN etype = 'duplicate_order_id' THEN 'order_id' END")
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


UNKNOWN_KEY = "customer_id does not exist in the known-customers reference set"
DUPLICATE = "order_id already exists in the clean data store from a previous run"
DUPLICATE_WHY = (
    "Duplicate orders aren''t auto-resolved; a human should decide whether "
    "this is a resubmission or a genuine conflict."
)


def _own(field: str) -> str:
    made = {"order_date": reformat, "amount": coerce}.get(field)
    return f"CASE WHEN active AND k_{field} IS NOT NULL THEN {made(field) if made else fix(field, field)} END AS own_{field}"


def diagnosis_stages(source: str, k: str) -> list[str]:
    """``d<k>``: the rows of a state table with failing fields and the heuristic diagnosis."""
    blank = " ".join(
        f"WHEN list_contains(failing, '{f}') AND ({f} IS NULL OR {f} = '') THEN '{f}'" for f in FIELDS
    )

    def pick(values: list[str], fk: str, dup: str, blank_text: str, other: str) -> str:
        own = " ".join(f"WHEN own_{f.name} IS NOT NULL THEN {v}" for f, v in zip(REMEDIED, values))
        return (
            f"CASE WHEN NOT active THEN NULL WHEN etype = 'invalid_foreign_key' THEN {fk} "
            f"WHEN etype = 'duplicate_order_id' THEN {dup} {own} "
            f"WHEN blank_field IS NOT NULL THEN {blank_text} ELSE {other} END"
        )

    def reason(f) -> str:
        return f"concat('{f.before}''', own_{f.name}, '''{f.after}')"

    return [
        f"f{k} AS (SELECT *, {_failing()} AS failing, {', '.join(_own(f.name) for f in REMEDIED)} FROM {source})",
        f"b{k} AS (SELECT *, CASE {blank} END AS blank_field FROM f{k})",
        f"""d{k} AS (SELECT *,
          {pick([f"'{f.transform}'" for f in REMEDIED], 'NULL', 'NULL', 'NULL', 'NULL')} AS transform,
          {pick([f"'{f.hypothesis}'" for f in REMEDIED], f"'{UNKNOWN_KEY}'", f"'{DUPLICATE}'",
                "concat(blank_field, ' is missing or blank')",
                "concat(array_to_string(failing, ', '), ' fails validation and no registered transform applies')")} AS hypothesis,
          {pick([f"cast({f.confidence} AS double)" for f in REMEDIED], '1.0', '1.0', '1.0', '1.0')} AS confidence,
          {pick([reason(f) for f in REMEDIED], "'Unresolvable foreign key has no safe automatic fix.'", f"'{DUPLICATE_WHY}'",
                "'Missing required field has no safe automatic fix.'",
                "'No pre-approved transform matched; declining rather than guessing.'")} AS reasoning
        FROM b{k})""",
    ]


def candidate_stage(k: str) -> str:
    """``x<k>``: the field that the proposed transform repairs first, and its new value."""
    cands = ", ".join(f"CASE WHEN list_contains(failing, '{f}') THEN {apply_transform(f, f)} END AS c_{f}" for f in FIELDS)
    chosen = " ".join(f"WHEN c_{f} IS NOT NULL THEN '{f}'" for f in FIELDS)
    value = ", ".join(f"c_{f}" for f in FIELDS)
    return (
        f"x{k} AS (SELECT *, CASE {chosen} END AS fix_field, coalesce({value}) AS fix_value "
        f"FROM (SELECT *, {cands} FROM d{k}))"
    )


def start_stage(source: str = "checked") -> str:
    originals = ", ".join(f"{f} AS o_{f}" for f in FIELDS)
    return (
        f"s0 AS (SELECT run_id, row_index, mode, key_known, stripped_known, error_type, {originals}, "
        f"{', '.join(FIELDS)}, {', '.join('k_' + f for f in FIELDS)}, error_type AS etype, true AS active, "
        f"false AS healed, CAST(NULL AS VARCHAR) AS reason, "
        f"[] :: STRUCT(hypothesis VARCHAR, transform VARCHAR, confidence DOUBLE, reasoning VARCHAR, fixed BOOLEAN, "
        f"row_after VARCHAR)[] AS attempts FROM {source} WHERE error_type IS NOT NULL)"
    )


def attempt_stages(n: int) -> list[str]:
    k, before = str(n), f"s{n - 1}"
    keep = "run_id, row_index, mode, key_known, stripped_known, error_type, " + ", ".join(f"o_{f}" for f in FIELDS)
    values = ", ".join(f"CASE WHEN fix_field = '{f}' THEN fix_value ELSE {f} END AS {f}" for f in FIELDS)
    carried = ", ".join(f"k_{f} AS p_{f}" for f in FIELDS)
    kinds = ", ".join(f"CASE WHEN fixed THEN {kind(f, f)} ELSE p_{f} END AS k_{f}" for f in FIELDS)
    known_now = "CASE WHEN customer_id IS NOT DISTINCT FROM o_customer_id THEN key_known ELSE stripped_known END"
    after = "concat_ws('|', " + ", ".join(FIELDS) + ")"
    return [
        *diagnosis_stages(before, k),
        candidate_stage(k),
        f"""n{k} AS (SELECT {keep}, etype, active, healed, reason, attempts, hypothesis, transform, confidence, reasoning,
          active AND fix_field IS NOT NULL AS fixed, {values}, {carried} FROM x{k})""",
        f"j{k} AS (SELECT *, {kinds} FROM n{k})",
        f"""e{k} AS (SELECT *, CASE WHEN NOT fixed THEN etype ELSE coalesce({first_kind()},
          CASE WHEN NOT {known_now} THEN 'invalid_foreign_key' END) END AS next_type FROM j{k})""",
        f"""s{k} AS (SELECT {keep}, {', '.join(FIELDS)}, {', '.join('k_' + f for f in FIELDS)}, next_type AS etype,
          fixed AND next_type IS NOT NULL AS active, healed OR (fixed AND next_type IS NULL) AS healed,
          CASE WHEN active AND NOT fixed THEN 'no_fix' ELSE reason END AS reason,
          CASE WHEN active THEN list_append(attempts, {{'hypothesis': hypothesis, 'transform': transform,
            'confidence': confidence, 'reasoning': reasoning, 'fixed': fixed,
            'row_after': CASE WHEN fixed THEN {after} END}}) ELSE attempts END AS attempts FROM e{k})""",
    ]


def loop_stages(attempts: int = 3) -> list[str]:
    """``repaired``: invalid rows of the first pass after the loop."""
    out = [start_stage()]
    for n in range(1, attempts + 1):
        out += attempt_stages(n)
    out.append(
        f"repaired AS (SELECT * EXCLUDE (reason), CASE WHEN active THEN 'attempts_exhausted' ELSE reason END AS end_reason FROM s{attempts})"
    )
    return out


def _settled(store: bool, many_runs: bool) -> list[str]:
    in_store = "order_id IN (SELECT order_id FROM held)" if store else "false"
    earlier = "min(run_id) OVER (PARTITION BY order_id) < run_id" if many_runs else "false"
    run = "run_id" if many_runs else "CAST(1 AS BIGINT)"
    return [
        f"""claims AS (
          SELECT {run} AS run_id, row_index, order_id, false AS healed FROM checked WHERE error_type IS NULL
          UNION ALL SELECT {run}, row_index, order_id, true FROM repaired WHERE healed)""",
        f"""ranked AS (SELECT *, {in_store} OR {earlier} AS taken,
          min(CASE WHEN NOT healed THEN row_index END) OVER (PARTITION BY run_id, order_id) AS first_valid,
          min(CASE WHEN healed THEN row_index END) OVER (PARTITION BY run_id, order_id) AS first_healed FROM claims)""",
        """verdict AS (SELECT row_index, healed, CASE WHEN healed
            THEN (first_valid IS NOT NULL AND NOT taken) OR first_healed < row_index
            ELSE taken OR first_valid < row_index END AS hit FROM ranked)""",
        f"""settled AS (
          SELECT {run.replace('run_id', 'c.run_id')} AS run_id, c.row_index, c.mode, {', '.join('c.' + f for f in FIELDS)},
            {', '.join('c.k_' + f for f in FIELDS)},
            CASE WHEN c.error_type IS NULL AND v.hit THEN 'duplicate_order_id' ELSE c.error_type END AS error_type,
            coalesce(r.healed AND NOT coalesce(v.hit, false), false) AS healed,
            CASE WHEN v.hit THEN 'no_fix' ELSE r.end_reason END AS end_reason,
            CASE WHEN c.error_type IS NULL AND NOT v.hit THEN 'clean'
                 WHEN r.healed AND NOT v.hit THEN 'healed' ELSE 'quarantined' END AS disposition,
            CASE WHEN c.error_type IS NULL AND v.hit THEN [{{'hypothesis': '{DUPLICATE}', 'transform': CAST(NULL AS VARCHAR),
                   'confidence': cast(1.0 AS double), 'reasoning': '{DUPLICATE_WHY}', 'fixed': false, 'row_after': CAST(NULL AS VARCHAR)}}]
                 WHEN c.error_type IS NULL THEN [] ELSE r.attempts END AS attempts,
            {', '.join(f'CASE WHEN c.error_type IS NULL THEN c.{f} ELSE r.{f} END AS final_{f}' for f in FIELDS)}
          FROM checked c LEFT JOIN repaired r ON c.row_index = r.row_index LEFT JOIN verdict v ON c.row_index = v.row_index)""",
    ]


def settled_stages(store: bool = True, many_runs: bool = True) -> list[str]:
    return [*FIRST_PASS, _HELD, *loop_stages(), *_settled(store, many_runs)]


IDENTIFIER = "coalesce(nullif(order_id, ''), concat('row-', row_index))"

AUDIT = f"""audit AS (
  SELECT run_id, row_index, attempt_no, {IDENTIFIER} AS row_identifier, a.hypothesis AS hypothesis,
    a.transform AS transform_chosen, a.confidence AS confidence, a.reasoning AS reasoning, 'heuristic' AS diagnosis_source,
    CASE WHEN healed AND attempt_no = len(attempts) THEN 'healed' WHEN a.transform IS NULL THEN 'no_fix'
         ELSE 'still_invalid' END AS outcome
  FROM (SELECT *, unnest(attempts) AS a, unnest(range(1, len(attempts) + 1)) AS attempt_no FROM settled))"""

_ERRORS = ", ".join(
    f"CASE WHEN k_{f} IS NOT NULL THEN concat('{f}: ', {message(f, 'k_' + f)}) END" for f in FIELDS
)
DETAIL = (
    "CASE WHEN error_type = 'invalid_foreign_key' THEN concat('customer_id: Unknown customer_id: ', customer_id) "
    "WHEN error_type = 'duplicate_order_id' THEN concat('order_id: Duplicate order_id: ', order_id) "
    f"ELSE array_to_string(list_filter([{_ERRORS}], lambda x: x IS NOT NULL), '; ') END"
)
QUARANTINE = f"""quarantine AS (
  SELECT run_id, row_index, error_type, {DETAIL} AS error_detail, len(attempts) AS attempt_count, attempts,
    end_reason, row_index % 5 = 0 AS resolved, {', '.join(FIELDS)}
  FROM settled WHERE disposition = 'quarantined')"""

RUNS = """runs AS (
  SELECT run_id, count(*) AS row_count, count(*) FILTER (disposition = 'clean') AS clean_first_pass,
    count(*) FILTER (disposition = 'healed') AS healed, count(*) FILTER (disposition = 'quarantined') AS quarantined,
    CASE WHEN run_id % 11 = 0 THEN 'failed' WHEN run_id % 13 = 0 THEN 'rejected_schema_drift'
         WHEN run_id % 17 = 0 THEN 'running' ELSE 'completed' END AS status,
    TIMESTAMP '2026-01-01 00:00:00' + to_minutes(run_id) AS started_at
  FROM settled GROUP BY run_id)"""
ERROR_COUNTS = "error_counts AS (SELECT run_id, error_type AS key, count(*) AS n FROM settled WHERE error_type IS NOT NULL GROUP BY ALL)"
FIX_COUNTS = """fix_counts AS (SELECT run_id, a.transform AS key, count(*) AS n
  FROM (SELECT run_id, unnest(attempts) AS a FROM settled) WHERE a.transform IS NOT NULL GROUP BY ALL)"""

TABLES = [*settled_stages(), AUDIT, QUARANTINE, RUNS, ERROR_COUNTS, FIX_COUNTS]


def label(x: str) -> str:
    words = f"list_transform(string_split({x}, '_'), lambda w: CASE WHEN w = 'id' THEN 'ID' ELSE w END)"
    text = f"array_to_string({words}, ' ')"
    return f"concat(upper(substr({text}, 1, 1)), substr({text}, 2))"


def statement(stages: list[str], select: str) -> str:
    return "WITH " + ",\n".join(stages) + "\n" + select
