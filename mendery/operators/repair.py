"""The bounded repair loop.

The loop is one ``reduce`` expression over the attempt numbers, whose state is the row as repaired so far,
what is still wrong with it and the attempts made. Its body stands in the plan once, whatever the number
of attempts, and nothing is shuffled. Unrolling it into projections does not work: predicates on its
results are pushed down through every projection, and each step multiplies them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendery.contract import Contract, Pattern, TransformRegistry, built_in_transforms
from mendery.functions.binding import let
from mendery.functions.ids import fix_encoding
from mendery.operators.checks import kind_of
from mendery.operators.diagnose import DIAGNOSIS_TYPE, first_fixed, heuristic_diagnosis, own_remedy
from mendery.operators.lookup import known_flag
from mendery.session import settle_table

MAX_ATTEMPTS = 3

# Turns a frame with __state, __failing, __errors and __heuristic into one with __diagnosis.
Diagnoser = Callable[[DataFrame], DataFrame]


def computed_once(frame: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections read but never recompute.

    ``inline`` of a one-element array is a generator, and predicates on the output of a generator stay
    above it. A plain projection would be substituted into every predicate that uses it.
    """
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    return frame.select("*", F.inline(F.array(packed)))


def row_type(contract: Contract) -> str:
    return "struct<" + ",".join(f"{n}:string" for n in contract.columns) + ">"


def attempt_type(contract: Contract) -> str:
    inner = DIAGNOSIS_TYPE.removeprefix("struct<").removesuffix(">")
    return f"array<struct<{inner},row_after:{row_type(contract)}>>"


def _state_type(contract: Contract) -> str:
    row = row_type(contract)
    return (
        f"struct<row:{row},kinds:{row},type:string,active:boolean,healed:boolean,end_reason:string,"
        f"attempts:{attempt_type(contract)}>"
    )


def candidate_fix(transform: Column, failing: Column, registry: TransformRegistry) -> Column:
    """Try one transform on every failing field in error order; the first repair wins.

    A diagnosis names a transform but no field, so the repaired field need not be the diagnosed one.
    """
    return first_fixed(
        F.transform(
            failing,
            lambda e: F.struct(
                e["field"].alias("field"),
                registry.apply(transform, e["value"], e["field"]).alias("fixed"),
            ),
        )
    )


class RepairLoop:
    """The steps of an attempt as Column functions over the loop state."""

    def __init__(self, contract: Contract, registry: TransformRegistry, trust_new_keys: bool = False):
        """``trust_new_keys``: foreign keys that were not looked up before the loop count as known."""
        self.contract, self.registry, self.trust_new_keys = contract, registry, trust_new_keys
        self.type = _state_type(contract)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, RepairLoop) and self._key() == other._key()

    def __hash__(self) -> int:
        return hash(self._key())

    def _key(self) -> tuple:
        return (self.contract, self.registry, self.trust_new_keys)

    def known_now(self, key: Column) -> Column:
        """Whether a value of the foreign key, at this point of the loop, is known."""
        other = F.lit(True) if self.trust_new_keys else F.col("__stripped_known")
        return F.when(key.eqNullSafe(F.col(self.contract.foreign_key)), F.col("key_known")).otherwise(other)

    def start(self) -> Column:
        contract = self.contract
        return F.struct(
            F.struct(*contract.columns).alias("row"),
            F.struct(*[kind_of(n).alias(n) for n in contract.columns]).alias("kinds"),
            F.col("error_type").alias("type"),
            F.col("error_type").isNotNull().alias("active"),
            F.lit(False).alias("healed"),
            F.lit(None).cast("string").alias("end_reason"),
            F.array().cast(attempt_type(contract)).alias("attempts"),
        ).cast(self.type)

    def failing(self, state: Column) -> Column:
        return self.contract.failing(lambda n: state["row"][n], lambda n: state["kinds"][n], state["type"])

    def heuristic(self, state: Column, failing: Column) -> Column:
        return let(
            own_remedy(failing, self.contract, self.registry),
            lambda own: heuristic_diagnosis(state["type"], failing, own, self.contract),
        )

    def apply(self, state: Column, failing: Column, diagnosis: Column) -> Column:
        """State after acting on a diagnosis."""
        fix = F.when(
            diagnosis["transform"].isNotNull(),
            candidate_fix(diagnosis["transform"], failing, self.registry),
        )
        return let(
            fix,
            lambda f: F.when(f.isNull(), self._stopped(state, diagnosis)).otherwise(
                let(self._with_fix(state, f), lambda row: self._judged(state, diagnosis, row))
            ),
        )

    def step(self, state: Column) -> Column:
        """One attempt with the heuristic diagnosis; a row that is done stays as it is."""
        attempted = let(
            self.failing(state),
            lambda failing: let(self.heuristic(state, failing), lambda d: self.apply(state, failing, d)),
        )
        return F.when(state["active"], attempted).otherwise(state)

    def _with_fix(self, state: Column, fix: Column) -> Column:
        row = state["row"]
        return F.struct(
            *[F.when(fix["field"] == n, fix["fixed"]).otherwise(row[n]).alias(n) for n in self.contract.columns]
        )

    def _entry(self, diagnosis: Column, row_after: Column) -> Column:
        return F.struct(
            *[diagnosis[k].alias(k) for k in ("hypothesis", "transform", "confidence", "reasoning", "source")],
            row_after.alias("row_after"),
        )

    def _state(self, row, kinds, kind, active, healed, reason, attempts) -> Column:
        return F.struct(
            row.alias("row"),
            kinds.alias("kinds"),
            kind.alias("type"),
            active.alias("active"),
            healed.alias("healed"),
            reason.alias("end_reason"),
            attempts.alias("attempts"),
        )

    def _stopped(self, state: Column, diagnosis: Column) -> Column:
        """Nothing was proposed, or the proposal applies nowhere."""
        entry = self._entry(diagnosis, F.lit(None).cast(row_type(self.contract)))
        return self._state(
            state["row"],
            state["kinds"],
            state["type"],
            F.lit(False),
            F.lit(False),
            F.lit("no_fix"),
            F.concat(state["attempts"], F.array(entry)),
        )

    def _judged(self, state: Column, diagnosis: Column, row: Column) -> Column:
        """Re-validate a repaired row: contract, then foreign key. Duplicates are not looked at."""
        contract = self.contract
        failures = contract.failures(lambda n: row[n])
        kinds = F.struct(*[failures[n].alias(n) for n in contract.columns])
        attempts = F.concat(state["attempts"], F.array(self._entry(diagnosis, row)))

        def finish(k: Column) -> Column:
            fk_error = F.lit(None).cast("string")
            if contract.foreign_key is not None:
                fk_error = F.when(~self.known_now(row[contract.foreign_key]), F.lit("invalid_foreign_key"))
            error = F.coalesce(contract.first_failure(lambda n: k[n]), fk_error)
            return let(
                error,
                lambda e: self._state(
                    row, k, e, e.isNotNull(), e.isNull(), F.lit(None).cast("string"), attempts
                ),
            )

        return let(kinds, finish)


@lru_cache(maxsize=32)
def first_diagnosis(loop: RepairLoop) -> tuple[Column, Column, Column]:
    """State at the start, failing fields and heuristic diagnosis, over columns ``__state`` and ``failing``."""
    state = F.col("__state")
    return loop.start(), loop.failing(state), loop.heuristic(state, F.col("failing"))


@lru_cache(maxsize=32)
def _whole_loop(loop: RepairLoop, max_attempts: int) -> Column:
    """Final state of a row. Columns are unresolved trees, so a built one serves any number of frames."""
    tries = F.sequence(F.lit(1), F.lit(max_attempts))
    ended = F.reduce(tries, loop.start(), lambda state, _: loop.step(state))
    return F.when(F.col("error_type").isNull(), loop.start()).otherwise(ended)


def repair_rows(
    checked: DataFrame,
    contract: Contract,
    known: DataFrame | None = None,
    registry: TransformRegistry | None = None,
    max_attempts: int = MAX_ATTEMPTS,
    diagnoser: Diagnoser | None = None,
) -> DataFrame:
    """Repair the invalid rows of a checked frame; valid rows pass through untouched.

    Adds ``healed``, ``end_reason`` (``no_fix``, ``attempts_exhausted`` or NULL), ``attempts`` and
    ``final`` (the row as it stands after the last repair).

    Re-validation needs to know whether a repaired key is known. With the built-in transforms a repaired
    key can only be the key with its tail stripped, since the others yield numbers or dates, so that one
    candidate is looked up before the loop. Custom transforms can make any key: then each attempt is a
    step over the rows still open, and the keys it made are looked up before the next one, so that a row
    with an unknown key is diagnosed again with the attempts it has left.
    """
    if max_attempts < 1:
        raise ValueError("max_attempts must be at least 1")
    registry = registry or built_in_transforms(contract)
    fk = contract.foreign_key
    position = F.struct("run_id", "row_index")
    looked_up = fk is not None and known is not None
    custom = looked_up and set(registry.ids) != set(built_in_transforms(contract).ids)

    frame = checked
    if looked_up and not custom and isinstance(contract[fk].rule, Pattern):
        stripped = F.when(kind_of(fk).isNotNull(), fix_encoding(F.col(fk), contract[fk].rule.anchored))
        frame = known_flag(frame, stripped, known, "__stripped_known", position)
    else:
        frame = frame.withColumn("__stripped_known", F.lit(not looked_up))

    loop = RepairLoop(contract, registry, custom)
    if custom:
        frame = _attempts_with_lookups(frame, loop, known, max_attempts, diagnoser)
    elif diagnoser is None:
        frame = computed_once(frame, __state=_whole_loop(loop, max_attempts))
    else:
        frame = computed_once(frame, __state=loop.start())
        for _ in range(max_attempts):
            frame = _attempt_with(frame, loop, diagnoser)

    state = F.col("__state")
    timed = ["heal_ms"] if "heal_ms" in frame.columns else []
    return frame.select(
        *checked.columns,
        state["healed"].alias("healed"),
        F.when(state["active"], F.lit("attempts_exhausted")).otherwise(state["end_reason"]).alias("end_reason"),
        state["attempts"].alias("attempts"),
        state["row"].alias("final"),
        *timed,
    )


def _attempts_with_lookups(
    frame: DataFrame, loop: RepairLoop, known: DataFrame, max_attempts: int, diagnoser: Diagnoser | None
) -> DataFrame:
    """The loop as one pass per attempt over the rows that are still open.

    Inside an attempt new keys count as known; those of rows that this would heal are then looked up, each
    distinct key once, and rows whose key is unknown go on with that error. Every pass is written, so that
    the next one starts from the open rows alone and no attempt is made twice.
    """
    frame, ended = computed_once(frame, __state=loop.start()), []
    state = F.col("__state")
    for _ in range(max_attempts):
        if diagnoser is None:
            after = F.when(state["active"], loop.step(state)).otherwise(state)
            frame = computed_once(frame, __after=after).drop("__state").withColumnRenamed("__after", "__state")
        else:
            frame = _attempt_with(frame, loop, diagnoser)
        frame = settle_table(_with_known_keys(frame, loop, known), "attempt")
        ended.append(frame.filter(~state["active"]))
        frame = frame.filter(state["active"])
        if frame.isEmpty():
            break
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*ended, frame])


def _with_known_keys(frame: DataFrame, loop: RepairLoop, known: DataFrame) -> DataFrame:
    """Take back the healing of rows whose new foreign key is unknown: they stay open with that error."""
    state, fk = F.col("__state"), loop.contract.foreign_key
    made = state["healed"] & ~state["row"][fk].eqNullSafe(F.col(fk))
    frame = known_flag(frame, F.when(made, state["row"][fk]), known, "__made_known", F.struct("run_id", "row_index"))
    unknown = loop._state(
        state["row"], state["kinds"], F.lit("invalid_foreign_key"), F.lit(True), F.lit(False), F.lit(None).cast("string"), state["attempts"]
    )
    checked = F.when(made & ~F.col("__made_known"), unknown).otherwise(state)
    return computed_once(frame, __checked=checked.cast(loop.type)).drop("__state", "__made_known").withColumnRenamed("__checked", "__state")


def _attempt_with(frame: DataFrame, loop: RepairLoop, diagnoser: Diagnoser) -> DataFrame:
    """One attempt whose diagnosis comes from outside the expression."""
    state = F.col("__state")
    active = state["active"]
    contract = loop.contract
    frame = computed_once(frame, __failing=F.when(active, loop.failing(state)))
    frame = computed_once(
        frame,
        __heuristic=F.when(active, loop.heuristic(state, F.col("__failing"))),
        __errors=F.when(
            active,
            contract.errors(lambda n: state["row"][n], lambda n: state["kinds"][n], state["type"]),
        ),
    )
    frame = diagnoser(frame)
    after = F.when(active, loop.apply(state, F.col("__failing"), F.col("__diagnosis"))).otherwise(state)
    frame = computed_once(frame, __after=after)
    helpers = ("__failing", "__heuristic", "__errors", "__diagnosis", "__state", "__call")
    return frame.drop(*helpers).withColumnRenamed("__after", "__state")
