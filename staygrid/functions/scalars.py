"""Null-safe comparisons, parsing, mapping and arithmetic on columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from staygrid.schema import as_column

OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.try_divide(a, b),
    "^": F.pow,
}

COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def round_to(x: str | Column, to: float = 1.0) -> Column:
    """Nearest multiple of ``to``; ties go to the even multiple."""
    return F.bround(as_column(x) / F.lit(float(to)), 0) * F.lit(float(to))


def is_true(x: str | Column) -> Column:
    return F.coalesce(as_column(x).cast("boolean"), F.lit(False))


def is_false(x: str | Column) -> Column:
    """True where the value is known and false."""
    return F.coalesce(~as_column(x).cast("boolean"), F.lit(False))


def is_val(x: str | Column, value) -> Column:
    return F.coalesce(as_column(x) == F.lit(value), F.lit(False))


def not_val(x: str | Column, value) -> Column:
    return F.coalesce(as_column(x) != F.lit(value), F.lit(False))


def val_or_na(x: str | Column, value) -> Column:
    return F.coalesce(as_column(x) == F.lit(value), F.lit(True))


def comp_na(x: str | Column, op: str, value) -> Column:
    """Comparison where a missing value compares as false."""
    return F.coalesce(COMPARISONS[op](as_column(x), F.lit(value)), F.lit(False))


def coalesce(*columns: str | Column) -> Column:
    return F.coalesce(*[as_column(c) for c in columns])


def to_number(x: str | Column) -> Column:
    """Number, or null where the text is not one."""
    text = F.trim(as_column(x).cast("string"))
    number = text.try_cast("double")
    return F.when(~F.isnan(number), number)


def number(df: DataFrame, column: str) -> Column:
    """A column as number; text is parsed, numeric columns are left as they are."""
    return F.col(column) if isinstance(df.schema[column].dataType, T.NumericType) else to_number(column)


def force_type(x: str | Column, dtype: str) -> Column:
    return as_column(x).try_cast(dtype)


def percent_as_number(x: str | Column) -> Column:
    return to_number(F.regexp_replace(as_column(x).cast("string"), "%", ""))


def binary_op(x: str | Column, op: str, y) -> Column:
    return OPERATORS[op](as_column(x), y if isinstance(y, Column) else F.lit(y))


def set_val(value) -> Column:
    return F.lit(value)


def apply_map(x: str | Column, mapping: dict) -> Column:
    """Look a value up in a small fixed mapping; unmapped becomes null."""
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), as_column(x))


def sub_trans(x: str | Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(as_column(x), pattern, replacement)


def extract_unit(x: str | Column) -> Column:
    """Unit in the first brackets of a drug name, null if there is none."""
    return F.nullif(F.regexp_extract(as_column(x), r"\(([^)]+)\)", 1), F.lit(""))


def unit_of_seconds(x: str | Column) -> Column:
    """Name of the largest unit a duration in seconds is a whole number of."""
    s = as_column(x)
    return (
        F.when(s % 86_400 == 0, "day")
        .when(s % 3_600 == 0, "hour")
        .when(s % 60 == 0, "min")
        .when(s % 1 == 0, "sec")
        .when((s * 1_000) % 1 == 0, "millisec")
        .otherwise("microsec")
    )


def sum_known(*columns: str | Column) -> Column:
    """Row-wise sum over the known values, null when all are missing."""
    cols = [as_column(c) for c in columns]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cols])
    return F.when(F.coalesce(*cols).isNotNull(), total)


def any_known(*columns: str | Column) -> Column:
    return F.coalesce(*[as_column(c) for c in columns]).isNotNull()


def combine(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Compose frame transforms, applied left to right."""
    return lambda df: reduce(lambda frame, step: frame.transform(step), steps, df)
