"""Scalar functions of report expressions, by the names that reports use.

All of them are JVM expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def substring(text: Column, start: int, length: int) -> Column:
    """1-based substring."""
    if start < 1:
        raise ValueError("substring starts at 1")
    return F.substring(text, start, length)


def length(text: Column) -> Column:
    return F.length(text).cast("long")


def ceiling(value: Column) -> Column:
    return F.ceil(value).cast("long")


def floor(value: Column) -> Column:
    return F.floor(value).cast("long")


def extract(part: str, value: Column) -> Column:
    """``extract(year | month | day, value)``."""
    return {"year": F.year, "month": F.month, "day": F.day}[part.lower()](value).cast("long")


def if_then_else(condition: Column, then: Column, otherwise: Column) -> Column:
    """A null condition takes the else branch."""
    return F.when(condition, then).otherwise(otherwise)


def case(clauses: Sequence[tuple[Column, Column]], default: Column | None = None) -> Column:
    """Searched case; a missing else is null."""
    (condition, value), *rest = clauses
    result = F.when(condition, value)
    for condition, value in rest:
        result = result.when(condition, value)
    return result if default is None else result.otherwise(default)


def switch(value: Column, pairs: Sequence[tuple[object, object]], default: object = None) -> Column:
    """Multi-way choice by equality."""
    clauses = [(value == F.lit(key), F.lit(result)) for key, result in pairs]
    return case(clauses, F.lit(default))


def divide(numerator: Column, denominator: Column) -> Column:
    """Division that gives null where the denominator is zero."""
    return F.try_divide(numerator, denominator)


def concat(*parts: Column) -> Column:
    """``a || b``: null if any part is null."""
    return F.concat(*parts)


def add_years(day: Column, years: int) -> Column:
    """February 29 becomes February 28 in other years."""
    return F.add_months(day, 12 * years)


def today(as_of: datetime.date | None = None) -> Column:
    return F.current_date() if as_of is None else F.lit(as_of)


def now(as_of: datetime.datetime | None = None) -> Column:
    return F.current_timestamp() if as_of is None else F.lit(as_of)


def format_value(value: Column, format_string: str) -> Column:
    """Display text of a measure: ``#,##0.00`` style for numbers, a date pattern otherwise."""
    if "0" in format_string or "#" in format_string:
        decimals = len(format_string.partition(".")[2])
        return F.format_number(value, decimals)
    return F.date_format(value, format_string)


SCALARS = {
    "substring": substring,
    "character_length": length,
    "char_length": length,
    "length": length,
    "upper": F.upper,
    "lower": F.lower,
    "trim": F.trim,
    "abs": F.abs,
    "round": F.round,
    "_round": F.round,
    "ceiling": ceiling,
    "floor": floor,
    "sqrt": F.sqrt,
    "coalesce": F.coalesce,
    "nullif": F.nullif,
    "extract": extract,
    "if": if_then_else,
    "case": case,
    "switch": switch,
    "today": today,
    "now": now,
    "_add_years": add_years,
}
