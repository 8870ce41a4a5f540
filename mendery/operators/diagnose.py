"""Case analysis of an invalid row: what is wrong and which approved transform may help."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mendery.contract import Contract, TransformRegistry
from mendery.functions.text import is_blank

DIAGNOSIS_TYPE = "struct<hypothesis:string,transform:string,confidence:double,reasoning:string,source:string>"

# Wording of the heuristic diagnoses.
UNKNOWN_KEY_REASON = "Unresolvable foreign key has no safe automatic fix."
DUPLICATE_REASON = (
    "Duplicate orders aren't auto-resolved; a human should decide whether "
    "this is a resubmission or a genuine conflict."
)
BLANK_REASON = "Missing required field has no safe automatic fix."
NO_MATCH_REASON = "No pre-approved transform matched; declining rather than guessing."
HEURISTIC = "heuristic"


def diagnosis(hypothesis: Column, transform: Column, confidence: Column, reasoning: Column, source: Column) -> Column:
    return F.struct(
        hypothesis.alias("hypothesis"),
        transform.cast("string").alias("transform"),
        confidence.cast("double").alias("confidence"),
        reasoning.alias("reasoning"),
        source.alias("source"),
    )


def no_fix(hypothesis: Column | str, reasoning: str) -> Column:
    text = F.lit(hypothesis) if isinstance(hypothesis, str) else hypothesis
    return diagnosis(text, F.lit(None), F.lit(1.0), F.lit(reasoning), F.lit(HEURISTIC))


def unknown_key_diagnosis(contract: Contract) -> Column:
    return no_fix(
        f"{contract.foreign_key} does not exist in the known-{contract.known_noun} reference set",
        UNKNOWN_KEY_REASON,
    )


def duplicate_diagnosis(contract: Contract) -> Column:
    return no_fix(
        f"{contract.unique_key} already exists in the clean data store from a previous run",
        DUPLICATE_REASON,
    )


def own_remedy(failing: Column, contract: Contract, registry: TransformRegistry) -> Column:
    """First failing field that the remedy of its own field repairs: ``struct<field,fixed>`` or NULL."""

    def attempt(entry: Column) -> Column:
        made = F.lit(None).cast("string")
        for f in contract.fields:
            if f.remedy is not None:
                fixed = registry.builders[f.remedy.transform](entry["value"], F.lit(f.name))
                made = F.when(entry["field"] == f.name, fixed).otherwise(made)
        return F.struct(entry["field"].alias("field"), made.alias("fixed"))

    return first_fixed(F.transform(failing, attempt))


def first_fixed(candidates: Column) -> Column:
    """First element of ``array<struct<field,fixed>>`` with a repaired value."""
    return F.try_element_at(F.filter(candidates, lambda c: c["fixed"].isNotNull()), F.lit(1))


def heuristic_diagnosis(error_type: Column, failing: Column, own: Column, contract: Contract) -> Column:
    """Diagnosis of an invalid row.

    ``failing`` is the list of failing fields, ``own`` the result of :func:`own_remedy`.
    """
    blank = F.try_element_at(F.filter(failing, lambda e: is_blank(e["value"])), F.lit(1))["field"]
    named = F.array_join(F.transform(failing, lambda e: e["field"]), ", ")
    out = (
        F.when(error_type == "invalid_foreign_key", unknown_key_diagnosis(contract))
        .when(error_type == contract.duplicate_type, duplicate_diagnosis(contract))
    )
    for f in contract.fields:
        if f.remedy is not None:
            before, after = f.remedy.reasoning.split("{}")
            reasoning = F.concat(F.lit(f"{before}'"), own["fixed"], F.lit(f"'{after}"))
            out = out.when(
                own["field"] == f.name,
                diagnosis(
                    F.lit(f.remedy.hypothesis),
                    F.lit(f.remedy.transform),
                    F.lit(f.remedy.confidence),
                    reasoning,
                    F.lit(HEURISTIC),
                ),
            )
    return out.when(
        blank.isNotNull(), no_fix(F.concat(blank, F.lit(" is missing or blank")), BLANK_REASON)
    ).otherwise(
        no_fix(F.concat(named, F.lit(" fails validation and no registered transform applies")), NO_MATCH_REASON)
    )
