"""Declarative table contracts.

A :class:`Contract` lists the fields of a table with one rule each, plus at most one foreign key and
one unique key. Rules compile to Columns, so checking a table is a projection that Catalyst can fuse
with the scan. :data:`ORDERS` is the contract for orders.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from mendery.functions.amounts import coerce_amount, decimal_failure, decimal_value
from mendery.functions.dates import date_failure, date_value, reformat_date
from mendery.functions.ids import fix_encoding

ERROR_TYPE = "array<struct<field:string,msg:string,type:string>>"
RowGetter = Callable[[str], Column]


class Rule:
    """What one field accepts. ``failure`` is NULL for acceptable, non-null input."""

    sql_type = "string"

    def failure(self, value: Column) -> Column:
        raise NotImplementedError

    def messages(self, name: str) -> Mapping[str, str]:
        raise NotImplementedError

    def typed(self, value: Column) -> Column:
        return value


@dataclass(frozen=True)
class Pattern(Rule):
    """Text that matches ``regex`` from start to end."""

    regex: str

    @property
    def anchored(self) -> str:
        # Java's $ also matches before a final line break, so it is replaced by \z.
        return "^" + self.regex.removeprefix("^").removesuffix("$") + r"\z"

    def failure(self, value: Column) -> Column:
        return F.when(~value.rlike(self.anchored), F.lit("value_error"))

    def messages(self, name: str) -> Mapping[str, str]:
        return {"value_error": f"Value error, {name} must match {self.regex}"}


@dataclass(frozen=True)
class OneOf(Rule):
    """Text from a closed list, compared with its case."""

    values: tuple[str, ...]

    def failure(self, value: Column) -> Column:
        return F.when(~value.isin(*self.values), F.lit("enum"))

    def messages(self, name: str) -> Mapping[str, str]:
        quoted = [f"'{v}'" for v in self.values]
        listed = " or ".join(filter(None, [", ".join(quoted[:-1]), quoted[-1]]))
        return {"enum": f"Input should be {listed}"}


@dataclass(frozen=True)
class CalendarDate(Rule):
    """ISO date, datetime at midnight, or Unix time at midnight."""

    sql_type = "date"

    def failure(self, value: Column) -> Column:
        return date_failure(value)

    def messages(self, name: str) -> Mapping[str, str]:
        return {
            "date_from_datetime_parsing": "Input should be a valid date or datetime",
            "date_from_datetime_inexact": "Datetimes provided to dates should have zero time - e.g. be exact dates",
        }

    def typed(self, value: Column) -> Column:
        return date_value(value)


@dataclass(frozen=True)
class PositiveDecimal(Rule):
    """Finite decimal above zero with bounded digits; never rounded."""

    precision: int = 12
    scale: int = 2

    @property
    def sql_type(self) -> str:  # type: ignore[override]
        return f"decimal({self.precision},{self.scale})"

    def failure(self, value: Column) -> Column:
        return decimal_failure(value, self.precision, self.scale)

    def messages(self, name: str) -> Mapping[str, str]:
        whole = self.precision - self.scale
        return {
            "decimal_parsing": "Input should be a valid decimal",
            "finite_number": "Input should be a finite number",
            "decimal_max_digits": f"Decimal input should have no more than {self.precision} digits in total",
            "decimal_max_places": f"Decimal input should have no more than {self.scale} decimal places",
            "decimal_whole_digits": f"Decimal input should have no more than {whole} digits before the decimal point",
            "greater_than": "Input should be greater than 0",
        }

    def typed(self, value: Column) -> Column:
        return decimal_value(value, self.precision, self.scale)


@dataclass(frozen=True)
class Remedy:
    """The transform proposed when this field fails, and how the proposal is worded.

    ``reasoning`` holds ``{}`` where the quoted repaired value goes.
    """

    transform: str
    confidence: float
    hypothesis: str
    reasoning: str


@dataclass(frozen=True)
class Field:
    name: str
    rule: Rule
    required: bool = True
    remedy: Remedy | None = None

    def failure(self, value: Column) -> Column:
        """Error kind of this field's value, NULL when it passes."""
        if self.required:
            return F.when(value.isNull(), F.lit("missing")).otherwise(self.rule.failure(value))
        return F.when(value.isNotNull() & (value != ""), self.rule.failure(value))

    def message(self, kind: Column) -> Column:
        texts = {"missing": "Field required", **self.rule.messages(self.name)}
        out = None
        for key, text in texts.items():
            out = F.when(kind == key, F.lit(text)) if out is None else out.when(kind == key, F.lit(text))
        return out


@dataclass(frozen=True)
class Contract:
    name: str
    fields: tuple[Field, ...]
    foreign_key: str | None = None
    unique_key: str | None = None
    known_noun: str = "keys"
    columns: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        names = tuple(f.name for f in self.fields)
        if len(set(names)) != len(names):
            raise ValueError(f"Contract {self.name!r} declares a field twice")
        for key in (self.foreign_key, self.unique_key):
            if key is not None and key not in names:
                raise ValueError(f"Key {key!r} is not a field of contract {self.name!r}")
        object.__setattr__(self, "columns", names)

    def __getitem__(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(name)

    @property
    def duplicate_type(self) -> str:
        return f"duplicate_{self.unique_key}"

    def failures(self, get: RowGetter) -> dict[str, Column]:
        """One error-kind Column per field; every field is judged, whatever the others do."""
        return {f.name: f.failure(get(f.name)) for f in self.fields}

    def first_failure(self, kind: RowGetter) -> Column:
        """``invalid_<first failing field>`` or NULL."""
        return F.coalesce(*[F.when(kind(n).isNotNull(), F.lit(f"invalid_{n}")) for n in self.columns])

    def key_error(self, value: RowGetter, error_type: Column) -> Column:
        """Error entry of a row that fails a key check, NULL otherwise."""
        out = F.lit(None).cast("struct<field:string,msg:string,type:string>")
        if self.foreign_key:
            out = F.when(
                error_type == "invalid_foreign_key",
                _entry(self.foreign_key, F.concat(F.lit(f"Unknown {self.foreign_key}: "), value(self.foreign_key)), "referential_integrity"),
            ).otherwise(out)
        if self.unique_key:
            out = F.when(
                error_type == self.duplicate_type,
                _entry(self.unique_key, F.concat(F.lit(f"Duplicate {self.unique_key}: "), value(self.unique_key)), "duplicate"),
            ).otherwise(out)
        return out

    def errors(self, value: RowGetter, kind: RowGetter, error_type: Column) -> Column:
        """All errors of a row in field order, as ``array<struct<field,msg,type>>``.

        Built by concatenation, which keeps whole-stage code generation; ``filter`` would not.
        """
        none = F.array().cast(ERROR_TYPE)
        key_entry = self.key_error(value, error_type)
        parts = [F.when(key_entry.isNotNull(), F.array(key_entry)).otherwise(none)]
        for f in self.fields:
            k = kind(f.name)
            parts.append(F.when(k.isNotNull(), F.array(_entry(f.name, f.message(k), k))).otherwise(none))
        return F.concat(*parts)

    def failing(self, value: RowGetter, kind: RowGetter, error_type: Column) -> Column:
        """Failing fields with their current values, in error order."""
        shape = "array<struct<field:string,value:string>>"
        none = F.array().cast(shape)

        def one(name: str) -> Column:
            return F.array(F.struct(F.lit(name).alias("field"), value(name).alias("value"))).cast(shape)

        parts = [F.when(kind(n).isNotNull(), one(n)).otherwise(none) for n in self.columns]
        if self.foreign_key:
            parts.append(F.when(error_type == "invalid_foreign_key", one(self.foreign_key)).otherwise(none))
        if self.unique_key:
            parts.append(F.when(error_type == self.duplicate_type, one(self.unique_key)).otherwise(none))
        return F.concat(*parts)

    def typed(self, get: RowGetter) -> dict[str, Column]:
        """Typed values of an accepted row."""
        return {
            f.name: f.rule.typed(F.nullif(get(f.name), F.lit("")) if not f.required else get(f.name)).cast(f.rule.sql_type)
            for f in self.fields
        }


def _entry(name: str, msg: Column, kind: Column | str) -> Column:
    kind_col = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(F.lit(name).alias("field"), msg.alias("msg"), kind_col.alias("type"))


# ------------------------------------------------------------------------------- transforms


class TransformRegistry:
    """The closed set of repairs: transform id -> ``(value, field name) -> repaired value or NULL``.

    A builder gets Columns and returns a Column, so a registered transform never runs Python per row.
    Every id must have a builder; diagnoses that name anything else are refused. A custom transform
    that rewrites the foreign key is checked against the known keys in the attempt that made the key; a
    row whose new key is unknown is diagnosed again, with the attempts it has left.
    """

    def __init__(self, ids: tuple[str, ...], builders: Mapping[str, Callable[[Column, Column], Column]]):
        if set(ids) != set(builders):
            raise ValueError("Every transform id must have exactly one registered builder")
        self.ids = ids
        self.builders = dict(builders)

    def apply(self, transform: Column, value: Column, name: Column) -> Column:
        """Dispatch on the transform id; unknown ids give NULL."""
        out = None
        for key in self.ids:
            made = self.builders[key](value, name)
            out = F.when(transform == key, made) if out is None else out.when(transform == key, made)
        return out

    def extended(self, **builders: Callable[[Column, Column], Column]) -> "TransformRegistry":
        return TransformRegistry(self.ids + tuple(builders), {**self.builders, **builders})


BUILT_IN_TRANSFORMS = ("coerce_amount", "reformat_date", "fix_encoding")


@lru_cache(maxsize=64)
def built_in_transforms(contract: Contract) -> TransformRegistry:
    """The three approved transforms; ``fix_encoding`` serves the fields that have an id pattern."""

    def fix(value: Column, name: Column) -> Column:
        out = F.lit(None).cast("string")
        for f in contract.fields:
            if isinstance(f.rule, Pattern):
                out = F.when(name == f.name, fix_encoding(value, f.rule.anchored)).otherwise(out)
        return out

    return TransformRegistry(
        BUILT_IN_TRANSFORMS,
        {
            "coerce_amount": lambda v, n: coerce_amount(v),
            "reformat_date": lambda v, n: reformat_date(v),
            "fix_encoding": fix,
        },
    )


# ----------------------------------------------------------------------------------- orders

# Patterns, closed lists and remedy texts of the orders contract.
ORDER_ID_PATTERN = "^ORD-[A-Za-z0-9]{6,}$"
CUSTOMER_ID_PATTERN = "^CUST-[A-Za-z0-9]{4,}$"
CURRENCIES = ("USD", "EUR", "GBP", "CAD", "AUD", "JPY")
STATUSES = ("pending", "processing", "shipped", "delivered", "cancelled", "refunded")


def _id_remedy(name: str) -> Remedy:
    return Remedy(
        "fix_encoding",
        0.85,
        f"{name} has a trailing non-ASCII/mojibake artifact",
        "Stripping the trailing artifact recovers a valid value: {}.",
    )


ORDERS = Contract(
    name="orders",
    fields=(
        Field("order_id", Pattern(ORDER_ID_PATTERN), remedy=_id_remedy("order_id")),
        Field("customer_id", Pattern(CUSTOMER_ID_PATTERN), remedy=_id_remedy("customer_id")),
        Field(
            "order_date",
            CalendarDate(),
            remedy=Remedy(
                "reformat_date",
                0.9,
                "order_date is a real calendar date in a non-ISO format",
                "Reparsing recovers a valid ISO date: {}.",
            ),
        ),
        Field(
            "amount",
            PositiveDecimal(12, 2),
            remedy=Remedy(
                "coerce_amount",
                0.85,
                "amount contains currency symbols or non-numeric formatting noise",
                "Stripping non-numeric characters yields a valid positive amount: {}.",
            ),
        ),
        Field("currency", OneOf(CURRENCIES)),
        Field("status", OneOf(STATUSES)),
    ),
    foreign_key="customer_id",
    unique_key="order_id",
    known_noun="customers",
)
