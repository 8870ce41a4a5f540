"""Diagnoses from an external service, with the heuristic as the fallback.

No client is shipped. The user gives a factory that is called once per thread of a task and returns a callable
``(system_prompt, user_prompt) -> response text``. A failing call is a value, never an aborted job. Rows of one
attempt with equal prompts share one call and its answer, whatever it is.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendery.contract import Contract, TransformRegistry
from mendery.operators.diagnose import DIAGNOSIS_TYPE, diagnosis
from mendery.operators.lookup import keyed_lookup
from mendery.session import settle_table

Client = Callable[[str, str], str]
ClientFactory = Callable[[], Client]

MAX_IN_FLIGHT = 8
# A call is mostly waiting, so a task, which holds a core, has several under way.
CALLS_A_TASK = 4
EXTERNAL = "llm"

_CALL_TYPE = T.StructType(
    [
        T.StructField("response", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("elapsed_ms", T.DoubleType()),
    ]
)


def system_prompt(contract: Contract, registry: TransformRegistry) -> str:
    """Instructions for the service: the closed list of transforms and the answer format."""
    served: dict[str, list[str]] = {t: [] for t in registry.ids}
    for f in contract.fields:
        if f.remedy is not None and f.remedy.transform in served:
            served[f.remedy.transform].append(f.name)
    lines = [f"- {t}" + (f": for {' or '.join(names)}" if names else "") for t, names in served.items()]
    return "\n".join(
        [
            f"You diagnose invalid rows of the table '{contract.name}'.",
            "Name the most likely cause and choose exactly one of these transforms, or no_fix:",
            *lines,
            "- no_fix: for blanks, unknown keys and whatever cannot be repaired without guessing",
            "Do not invent values or transforms. Answer with one JSON object and nothing else, with the",
            "keys hypothesis (text), transform (text), confidence (number from 0 to 1), reasoning (text).",
        ]
    )


def user_prompt(row: Column, error_type: Column, errors: Column) -> Column:
    """The row, its error type and all of its errors as one text."""
    return F.concat(
        F.lit("Row data: "),
        F.to_json(row, {"ignoreNullFields": "false"}),
        F.lit("\nError type: "),
        error_type,
        F.lit("\nValidation errors: "),
        F.to_json(errors),
    )


def call_service(factory: ClientFactory, instructions: str, threads: int = 1):
    """Arrow-batched UDF ``prompt -> struct<response,error,elapsed_ms>`` with ``threads`` calls at a time a task.

    Only the prompt column crosses to Python. NULL prompts (rows that need no diagnosis) are not sent. Every
    thread has a client of its own.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = threading.local()

        def call(prompt: str | None) -> tuple[str | None, str | None, float | None]:
            if prompt is None or prompt != prompt:
                return None, None, None
            started = time.perf_counter()
            try:
                if not hasattr(own, "client"):
                    own.client = factory()
                response, error = own.client(instructions, prompt), None
            except Exception as exc:
                response, error = None, f"call failed: {exc}"
            return response, error, (time.perf_counter() - started) * 1000

        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                yield pd.DataFrame(list(pool.map(call, batch)), columns=["response", "error", "elapsed_ms"])

    return F.pandas_udf(run, _CALL_TYPE)


def shared_answers(
    prompts: DataFrame, factory: ClientFactory, instructions: str, max_in_flight: int = MAX_IN_FLIGHT
) -> DataFrame:
    """One row per different ``prompt``: its ``digest``, ``n_rows`` that have it, and the ``call``.

    Equal prompts meet after they were reduced where they lie, so one that very many rows have is asked once.
    Tasks times calls of a task is at most ``max_in_flight``.
    """
    tasks = max(max_in_flight // CALLS_A_TASK, 1)
    ask = call_service(factory, instructions, max(max_in_flight // tasks, 1))
    different = prompts.groupBy("digest").agg(F.any_value("prompt").alias("prompt"), F.count("*").alias("n_rows"))
    return different.repartition(tasks).select("digest", "n_rows", ask(F.col("prompt")).alias("call"))


def parse_response(response: Column, transforms: tuple[str, ...]) -> Column:
    """Validated diagnosis of a response text, as ``struct<diagnosis,error>``.

    A null hypothesis, transform or reasoning counts as missing and falls back to the heuristic. All members
    are read as text, because a typed schema would turn a quoted number into NULL. Exactly
    one of the two members is set.
    """
    fields = "hypothesis string, transform string, confidence string, reasoning string"
    parsed = F.from_json(response, fields, {"mode": "PERMISSIVE"})
    confidence = parsed["confidence"].try_cast("double")
    present = (
        parsed["hypothesis"].isNotNull() & parsed["transform"].isNotNull() & parsed["reasoning"].isNotNull()
    )
    usable = F.coalesce(present & confidence.isNotNull(), F.lit(False))
    in_range = (confidence >= 0) & (confidence <= 1)
    listed = parsed["transform"].isin("no_fix", *transforms)
    error = (
        F.when(~usable, F.concat(F.lit("unparseable response: "), F.coalesce(response, F.lit("none"))))
        .when(~in_range, F.concat(F.lit("confidence out of range: "), parsed["confidence"]))
        .when(~listed, F.concat(F.lit("unknown transform: "), parsed["transform"]))
    )
    made = diagnosis(
        parsed["hypothesis"],
        F.when(parsed["transform"] != "no_fix", parsed["transform"]),
        confidence,
        parsed["reasoning"],
        F.lit(EXTERNAL),
    )
    return F.struct(F.when(error.isNull(), made).cast(DIAGNOSIS_TYPE).alias("diagnosis"), error.alias("error"))


def external_diagnoser(
    factory: ClientFactory,
    contract: Contract,
    registry: TransformRegistry,
    max_in_flight: int = MAX_IN_FLIGHT,
) -> Callable[[DataFrame], DataFrame]:
    """A diagnoser for the repair loop that asks the service first.

    The rows are written before, and only the different prompts of rows that are still being repaired travel,
    to a few tasks with several calls each: at most ``max_in_flight`` run at the same time, and nothing else is
    narrowed. Answers are written to the shared folder before they are used, since asking again could give
    other answers: a lost executor must not change the result. They come back by the prompt's digest, in a
    join that stays even where very many rows share a prompt.
    """
    instructions = system_prompt(contract, registry)

    def diagnose(frame: DataFrame) -> DataFrame:
        state = F.col("__state")
        prompt = F.when(state["active"], user_prompt(state["row"], state["type"], F.col("__errors")))
        rows = settle_table(frame.withColumn("__prompt", prompt), "attempt")
        digest = F.sha2("__prompt", 256)
        prompts = rows.filter(F.col("__prompt").isNotNull()).select(digest.alias("digest"), F.col("__prompt").alias("prompt"))
        answers = shared_answers(prompts, factory, instructions, max_in_flight).withColumnRenamed("call", "__call")
        answered = keyed_lookup(
            rows.withColumn("__digest", digest).drop("__prompt"),
            answers,
            {"digest": F.col("__digest")},
            ["__call"],
            F.struct("run_id", "row_index"),
        ).drop("__digest")
        call = F.col("__call")
        answer = F.when(call.isNotNull() & call["error"].isNull(), parse_response(call["response"], registry.ids)["diagnosis"])
        before = F.col("heal_ms") if "heal_ms" in frame.columns else F.lit(0.0)
        return answered.withColumn("__diagnosis", F.coalesce(answer, F.col("__heuristic"))).withColumn(
            "heal_ms", before + F.coalesce(call["elapsed_ms"], F.lit(0.0))
        )

    return diagnose
