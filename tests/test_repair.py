"""Diagnosis and the repair loop."""

import itertools
import json
import time
import uuid

import pytest
from pyspark.sql import functions as F

from mendery.contract import ORDERS, TransformRegistry, built_in_transforms
from mendery.operators import checks, lookup
from mendery.operators.external import external_diagnoser, parse_response, system_prompt, user_prompt
from mendery.operators.faults import MOJIBAKE
from mendery.operators.repair import repair_rows
from mendery.plans import run_catalog
from mendery.plans.outcomes import Rules, audit_rows, clean_rows, outcomes, quarantine_rows, run_counts, unreconciled
from mendery.session import settle_table


def repaired(rows, known, **options):
    checked = checks.first_pass(rows, ORDERS, known)
    return repair_rows(checked, ORDERS, known, **options).orderBy("row_index").collect()


def steps(row):
    return [a["transform"] for a in row["attempts"]]


def test_healed_in_one_attempt(make_rows, known):
    (row,) = repaired(make_rows({"amount": "$49.99"}), known)
    assert row["healed"] and row["end_reason"] is None and row["final"]["amount"] == "49.99"
    (attempt,) = row["attempts"]
    assert attempt["transform"] == "coerce_amount" and attempt["confidence"] == 0.85 and attempt["source"] == "heuristic"
    assert attempt["reasoning"] == "Stripping non-numeric characters yields a valid positive amount: '49.99'."


def test_valid_rows_pass_through(make_rows, known, base):
    (row,) = repaired(make_rows({}), known)
    assert not row["healed"] and row["attempts"] == [] and row["final"].asDict() == base


CASES = [
    ({"amount": "49.123"}, False, "no_fix", [None]),
    ({"amount": "fifty-two"}, False, "no_fix", [None]),
    ({"order_date": "01/07/2026"}, True, None, ["reformat_date"]),
    ({"order_id": "ORD-000001" + MOJIBAKE}, True, None, ["fix_encoding"]),
    ({"customer_id": "CUST-0001" + MOJIBAKE}, True, None, ["fix_encoding"]),
    ({"customer_id": "CUST-9999" + MOJIBAKE}, False, "no_fix", ["fix_encoding", None]),
    ({"customer_id": "CUST-9999"}, False, "no_fix", [None]),
    ({"order_id": "", "amount": "$49.99"}, False, "no_fix", ["coerce_amount", None]),
    ({"order_date": "01/07/2026", "amount": "$5"}, True, None, ["reformat_date", "coerce_amount"]),
    ({"order_id": "1,234", "amount": "$5.00"}, False, "no_fix", ["coerce_amount", "coerce_amount", None]),
    ({"amount": "$Infinity"}, False, "no_fix", ["coerce_amount", None]),
    (
        {"order_id": "ORD-000001" + MOJIBAKE, "customer_id": "CUST-0001" + MOJIBAKE, "order_date": "01/07/2026", "amount": "$5"},
        False,
        "attempts_exhausted",
        ["fix_encoding", "fix_encoding", "reformat_date"],
    ),
]


def test_loop_cases(make_rows, known):
    rows = repaired(make_rows(*[c[0] for c in CASES]), known)
    assert [(r["healed"], r["end_reason"], steps(r)) for r in rows] == [c[1:] for c in CASES]
    wrong_field = rows[9]["attempts"][0]["row_after"]
    assert wrong_field["order_id"] == "1234" and wrong_field["amount"] == "$5.00"


def test_more_attempts_finish_the_hard_row(make_rows, known):
    (row,) = repaired(make_rows(CASES[-1][0]), known, max_attempts=4)
    assert row["healed"] and len(row["attempts"]) == 4
    with pytest.raises(ValueError):
        repaired(make_rows({}), known, max_attempts=0)


def test_heuristic_wording(make_rows, known):
    rows = repaired(
        make_rows({"order_id": "", "customer_id": ""}, {"currency": "ZZZ", "status": "x"}, {"customer_id": "CUST-9999"}),
        known,
    )
    assert [r["attempts"][0]["hypothesis"] for r in rows] == [
        "order_id is missing or blank",
        "currency, status fails validation and no registered transform applies",
        "customer_id does not exist in the known-customers reference set",
    ]
    assert all(r["attempts"][0]["confidence"] == 1.0 for r in rows)


def test_registry_must_be_complete():
    with pytest.raises(ValueError):
        TransformRegistry(("a", "b"), {"a": lambda v, n: v})
    with pytest.raises(ValueError):
        TransformRegistry(("a",), {"a": lambda v, n: v, "b": lambda v, n: v})


# ------------------------------------------------------------------------ external diagnoses


def answer(transform, confidence=0.9):
    return json.dumps({"hypothesis": "h", "transform": transform, "confidence": confidence, "reasoning": "r"})


def test_response_check(spark):
    cases = [
        (answer("coerce_amount"), "coerce_amount", None),
        (answer("no_fix"), None, None),
        (answer("coerce_amount", "0.5"), "coerce_amount", None),
        (answer("drop_table"), None, "unknown transform"),
        ("not json at all", None, "unparseable"),
        (answer("no_fix", 1.5), None, "confidence out of range"),
        (answer("no_fix", "high"), None, "unparseable"),
        (json.dumps({"transform": "no_fix", "confidence": 1}), None, "unparseable"),
        ("[1]", None, "unparseable"),
        (None, None, "unparseable"),
    ]
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, response string")
    parsed = frame.select("i", parse_response(F.col("response"), built_in_transforms(ORDERS).ids).alias("p"))
    for row, (_, transform, error) in zip(parsed.orderBy("i").collect(), cases):
        made = row["p"]["diagnosis"]
        if error is None:
            assert made["transform"] == transform and made["source"] == "llm" and row["p"]["error"] is None
        else:
            assert made is None and row["p"]["error"].startswith(error)


def test_prompts(spark, make_rows, known):
    checked = checks.with_errors(checks.first_pass(make_rows({"amount": "$5", "status": ""}), ORDERS, known), ORDERS)
    text = checked.select(user_prompt(F.struct(*ORDERS.columns), F.col("error_type"), F.col("errors"))).first()[0]
    assert text.startswith('Row data: {"order_id":"ORD-000001"') and "\nError type: invalid_amount\n" in text
    assert '"field":"amount"' in text and '"field":"status"' in text
    assert "- coerce_amount: for amount" in system_prompt(ORDERS, built_in_transforms(ORDERS))


def stubborn():
    return lambda system, user: answer("coerce_amount", 0.5)


def failing():
    def call(system, user):
        raise ConnectionError("service is down")

    return call


def broken_factory():
    raise RuntimeError("no key")


def by_content():
    def call(system, user):
        if "$" in user:
            return answer("coerce_amount", 0.7)
        return "nonsense"

    return call


def test_external_diagnosis_is_used_and_checked(make_rows, known):
    registry = built_in_transforms(ORDERS)
    rows = make_rows({"amount": "$5"}, {"order_date": "01/07/2026"}, {})
    got = repaired(rows, known, diagnoser=external_diagnoser(by_content, ORDERS, registry))
    assert [a["source"] for a in got[0]["attempts"]] == ["llm"] and got[0]["healed"]
    assert [a["source"] for a in got[1]["attempts"]] == ["heuristic"] and got[1]["healed"]
    assert got[2]["attempts"] == [] and got[0]["heal_ms"] >= 0


@pytest.mark.parametrize("factory", [failing, broken_factory])
def test_external_failure_falls_back(make_rows, known, factory):
    registry = built_in_transforms(ORDERS)
    (row,) = repaired(make_rows({"amount": "$5"}), known, diagnoser=external_diagnoser(factory, ORDERS, registry))
    assert row["healed"] and row["attempts"][0]["source"] == "heuristic"


def test_equal_prompts_are_asked_once_and_few_calls_run_at_a_time(make_rows, known, tmp_path):
    """Each call leaves a file with the times of its start and end."""
    log = str(tmp_path)

    def slow():
        def call(system, user):
            started = time.time()
            time.sleep(0.3)
            with open(f"{log}/{uuid.uuid4().hex}", "w") as out:
                print(started, time.time(), "$7" in user, file=out)
            return answer("coerce_amount", 0.7)

        return call

    registry = built_in_transforms(ORDERS)
    rows = make_rows(*[{"amount": "$7", "order_id": "ORD-000001"}] * 40, *[{"amount": f"${n}"} for n in range(100, 130)])
    got = repaired(rows, known, diagnoser=external_diagnoser(slow, ORDERS, registry))
    assert len(got) == 70 and all(a["source"] == "llm" for r in got for a in r["attempts"])
    assert all(r["heal_ms"] >= 300 for r in got)
    calls = [p.read_text().split() for p in tmp_path.iterdir()]
    assert len(calls) == 31 and sum(c[2] == "True" for c in calls) == 1
    edges = sorted([(float(c[0]), 1) for c in calls] + [(float(c[1]), -1) for c in calls])
    under_way = list(itertools.accumulate(step for _, step in edges))
    assert 2 < max(under_way) <= 8


def test_proposal_that_applies_nowhere(make_rows, known):
    """No repair: the reason is no_fix, yet the attempt names the transform."""
    registry = built_in_transforms(ORDERS)
    (row,) = repaired(make_rows({"currency": "ZZZ"}), known, diagnoser=external_diagnoser(stubborn, ORDERS, registry))
    assert not row["healed"] and row["end_reason"] == "no_fix" and steps(row) == ["coerce_amount"]


def test_attempts_exhausted_with_a_transform_that_never_helps(make_rows, known):
    registry = built_in_transforms(ORDERS).extended(add_dot=lambda v, n: F.concat(v, F.lit(".")))

    def client():
        return lambda system, user: answer("add_dot")

    (row,) = repaired(
        make_rows({"currency": "ZZZ"}), known, registry=registry, diagnoser=external_diagnoser(client, ORDERS, registry)
    )
    assert row["end_reason"] == "attempts_exhausted" and len(row["attempts"]) == 3
    assert row["final"]["currency"] == "ZZZ..."


def test_custom_transform_may_not_invent_a_key(make_rows, known):
    def factory():
        return lambda system, user: answer("redirect")

    for target, healed in (("CUST-9999", False), ("CUST-0007", True)):
        registry = built_in_transforms(ORDERS).extended(redirect=lambda v, n, t=target: F.when(n == "customer_id", F.lit(t)))
        (row,) = repaired(
            make_rows({"customer_id": "oops"}), known, registry=registry, diagnoser=external_diagnoser(factory, ORDERS, registry)
        )
        assert row["healed"] is healed and row["end_reason"] == (None if healed else "attempts_exhausted")
        assert steps(row) == ["redirect"] * (1 if healed else 3)


def with_bare_numbers():
    """A contract whose own remedy completes customer ids, so that the heuristic proposes it."""
    contract, rules = run_catalog.with_customer_lookup()
    complete = lambda v, n: F.when((n == "customer_id") & v.rlike("^[0-9]+$"), F.concat(F.lit("CUST-"), v))
    return contract, built_in_transforms(contract).extended(complete_customer=complete)


def test_keys_are_looked_up_inside_the_loop(make_rows, known):
    """A key that turns out unknown is diagnosed again in the same sequence of attempts; other errors first."""
    contract, registry = with_bare_numbers()
    rows = make_rows(
        {"customer_id": "0007"},
        {"customer_id": "9999"},
        {"customer_id": "9999", "amount": "$5"},
        {"customer_id": "0008", "amount": "$5"},
        {"customer_id": "9999", "amount": "$5", "order_date": "01/07/2026"},
        {},
        {"customer_id": "CUST-9999"},
        {"customer_id": "0009", "currency": "ZZZ"},
    )
    checked = checks.first_pass(rows, contract, known)
    got = repair_rows(checked, contract, known, registry).orderBy("row_index").collect()
    assert [(r["healed"], r["end_reason"], steps(r)) for r in got] == [
        (True, None, ["complete_customer"]),
        (False, "no_fix", ["complete_customer", None]),
        (False, "no_fix", ["complete_customer", "coerce_amount", None]),
        (True, None, ["complete_customer", "coerce_amount"]),
        (False, "attempts_exhausted", ["complete_customer", "reformat_date", "coerce_amount"]),
        (False, None, []),
        (False, "no_fix", [None]),
        (False, "no_fix", ["complete_customer", None]),
    ]
    again = got[1]["attempts"][1]
    assert again["hypothesis"] == "customer_id does not exist in the known-customers reference set" and again["row_after"] is None
    assert got[1]["final"]["customer_id"] == "CUST-9999"


def test_another_repair_may_follow_an_unknown_key(make_rows, known):
    """After the first key failed, the diagnosis of that error may name a transform that finds a known one."""

    def factory():
        return lambda system, user: answer("second" if "invalid_foreign_key" in user else "first")

    registry = built_in_transforms(ORDERS).extended(
        first=lambda v, n: F.when(n == "customer_id", F.lit("CUST-9999")), second=lambda v, n: F.when(n == "customer_id", F.lit("CUST-0003"))
    )
    (row,) = repaired(make_rows({"customer_id": "oops"}), known, registry=registry, diagnoser=external_diagnoser(factory, ORDERS, registry))
    assert row["healed"] and steps(row) == ["first", "second"] and row["final"]["customer_id"] == "CUST-0003"


def test_a_large_reference_is_reduced_by_the_keys_at_hand(spark, tmp_path, make_rows):
    """Beyond the broadcast limit the reference is scanned under a broadcast of the batch's keys, not shuffled."""
    spark.range(200_000).selectExpr("concat('CUST-', lpad(id, 8, '0')) AS customer_id").write.parquet(f"{tmp_path}/known")
    reference = spark.read.parquet(f"{tmp_path}/known")
    probes = spark.createDataFrame([("CUST-00000007",), ("CUST-99999999",)], "__probe string")
    held = lookup.held_by(reference.select(F.col("customer_id").alias("__known")), settle_table(probes, "probes"))
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi, BuildRight" in plan and "SortMergeJoin" not in plan
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
        rows = make_rows({"customer_id": "CUST-00000007"}, {"customer_id": "CUST-99999999"}, {"customer_id": None}, {"customer_id": "CUST-00199999"})
        got = lookup.known_flag(rows, F.col("customer_id"), reference, "known", F.col("row_index")).orderBy("row_index").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert [r["known"] for r in got] == [True, False, False, True]


# --------------------------------------------------------------------------- many runs, tables


def test_outcomes_of_a_mixed_batch(spark, make_rows, known):
    rows = make_rows(
        {}, {}, {}, {}, {}, {},
        {"amount": "$5"}, {"order_id": ""}, {"customer_id": "CUST-9999"}, {"order_id": "ORD-000001"}, {"currency": "ZZZ"},
    )
    settled = outcomes(rows, known)
    counts = run_counts(settled, Rules())
    (run,) = counts.collect()
    assert (run["row_count"], run["clean_first_pass"], run["healed"], run["quarantined"]) == (11, 6, 1, 4)
    assert run["error_types"] == {
        "invalid_amount": 1, "invalid_order_id": 1, "invalid_foreign_key": 1, "duplicate_order_id": 1, "invalid_currency": 1,
    }
    assert run["fixes_applied"] == {"coerce_amount": 1}
    sizes = rows.groupBy("run_id").agg(F.count("*").alias("rows_in"))
    assert unreconciled(counts, sizes).isEmpty()
    assert clean_rows(settled, ORDERS).count() == 7

    kept = {r["row_index"]: r for r in quarantine_rows(settled, ORDERS).collect()}
    assert kept[9]["error_detail"] == "order_id: Duplicate order_id: ORD-000001"
    assert kept[8]["error_detail"] == "customer_id: Unknown customer_id: CUST-9999"
    assert kept[7]["original_data"]["order_id"] == "" and kept[7]["resolved"] is False
    assert [h["source"] for h in kept[9]["diagnosis_history"]] == ["heuristic"]
    audit = {(r["row_identifier"], r["outcome"]) for r in audit_rows(settled, ORDERS).collect()}
    assert ("row-7", "no_fix") in audit and ("ORD-000007", "healed") in audit and len(audit) == 5


def test_healed_row_meets_a_taken_key(spark, make_rows, known):
    broken = {"order_id": "ORD-000001" + MOJIBAKE}
    # run 1: a clean row and two that heal to its id; run 2: one more; run 3: a clean row with the id
    rows = make_rows({}, broken, broken, {**broken, "run_id": 2}, {"order_id": "ORD-000001", "run_id": 3})
    by_index = {r["row_index"]: r for r in outcomes(rows, known).collect()}
    assert [by_index[i]["disposition"] for i in range(5)] == ["clean", "quarantined", "quarantined", "healed", "quarantined"]
    assert by_index[1]["quarantine_type"] == "duplicate_order_id" and by_index[1]["error_type"] == "invalid_order_id"
    strict = {r["row_index"]: r for r in outcomes(rows, known, rules=Rules(recheck_duplicates=True)).collect()}
    assert strict[3]["disposition"] == "quarantined"

    twice = make_rows({**broken, "run_id": 4}, {**broken, "run_id": 4})
    assert [r["disposition"] for r in outcomes(twice, known).orderBy("row_index").collect()] == ["healed", "quarantined"]
