"""Report expressions as Spark SQL text, for a whole column of expressions at once.

JVM expressions find what is called, what is not known, and plain references; they write arithmetic of columns and
numbers. Only texts that call, compare or nest go to Python (``parser.py``), each distinct one of a batch once. Case
expressions, comparisons, and/or/not and ``||`` already are Spark SQL.
"""

from __future__ import annotations

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from starfold.functions import parser

# The parser travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(parser)

AGGREGATES, KNOWN_CALLS = parser.AGGREGATES, sorted(parser.KNOWN_CALLS)

REFERENCE = r"(?:\[[^\[\]]++\]\.)*+\[[^\[\]]++\]"
_NUMBER = r"\d++(?:\.\d++)?"
_OPERAND = rf"(?:{REFERENCE}|{_NUMBER})"
# Columns and numbers with one sign between two of them.
_ARITHMETIC = rf"^{_OPERAND}(?:\s*+[+\-*/]\s*+{_OPERAND})*+$"
_CAST_OF_REFERENCE = rf"(?is)^cast\s*+\(\s*+{REFERENCE}\s*+;\s*+[a-z_][\w\-]*+\s*+\)$"
_HIDDEN = r"'(?:[^']|'')*+'|\[[^\[\]]*+\]|`[^`]*+`"  # what calls are not looked for in
_CALL = r"(?<![\w\-])([a-z_][\w\-]*+)\s*+\("
_CAST_TYPE = r";\s*+[a-z_][\w\-]*+\s*+\("
_READ = "sql string, columns array<struct<name: string, sql: string>>, is_aggregate boolean"


def _writer(rewrite):
    @F.pandas_udf(_READ)
    def write_all(expressions: pd.Series, aggregates: pd.Series) -> pd.DataFrame:
        known, rows = {}, []
        for key in zip(expressions, aggregates):
            if key not in known:
                found = rewrite(*key) if key[0] is not None else None
                known[key] = (found.sql, [{"name": c.name, "sql": c.sql} for c in found.columns], found.is_aggregate) if found else (None, None, None)
            rows.append(known[key])
        return pd.DataFrame(rows, columns=["sql", "columns", "is_aggregate"])

    return write_all


def _function(aggregate: Column) -> Column:
    """What opens the Spark aggregate of an item, null where it has none."""
    found = F.lit(None).cast("string")
    for name, function in AGGREGATES.items():
        found = F.when(aggregate == name, "count(distinct " if function == "count distinct" else f"{function}(").otherwise(found)
    return found


def _arithmetic_sql(text: Column, function: Column) -> Column:
    """Columns in backticks, in the aggregate if there is one, and divisors that are never zero."""
    guarded = F.regexp_replace(text, rf"/\s*+({_OPERAND})", "/ nullif($1, 0)")
    column = F.coalesce(F.concat(function, F.lit("`$1`)")), F.lit("`$1`"))
    return F.regexp_replace(guarded, F.lit(r"(?:\[[^\[\]]++\]\.)*+\[([^\[\]]++)\]"), column)


def _text(expression: Column) -> Column:
    return F.nullif(F.regexp_replace(expression, r"^\s+|\s+$", ""), F.lit(""))


def is_reference_like(expression: Column) -> Column:
    """Empty, a plain reference, or a cast of a plain reference."""
    text = _text(expression)
    return text.isNull() | text.rlike(rf"^{REFERENCE}$") | text.rlike(_CAST_OF_REFERENCE)


def unknown_calls(expression: Column) -> Column:
    """Names that are called and not known, lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(_text(expression)), _HIDDEN, "''"), _CAST_TYPE, ";")
    called = F.regexp_extract_all(bare, F.lit(_CALL), F.lit(1))
    known = F.array(*[F.lit(n) for n in [*KNOWN_CALLS, *parser.WORDS]])
    return F.coalesce(F.array_except(called, known), F.array().cast("array<string>"))


def read(expression: Column, aggregate: Column | None = None) -> Column:
    """A struct: reference_like, understood, unknown (called names), spark_sql, columns and is_aggregate.

    ``columns`` are the scoped aggregates of the text, in order: columns of those names that have to be added to the
    rows before ``spark_sql`` is evaluated over them, in an aggregation where ``is_aggregate``.
    """
    text, unknown = _text(expression), unknown_calls(expression)
    how = F.lit("") if aggregate is None else F.lower(F.trim(F.coalesce(aggregate, F.lit(""))))
    plain = text.rlike(_ARITHMETIC) & text.contains("[") & ~text.contains("`")
    written = _writer(parser.rewrite)(F.when(~plain & (F.size(unknown) == 0), text), how)
    function = _function(how)
    sql = F.when(plain, _arithmetic_sql(text, function)).otherwise(written.getField("sql"))
    return F.struct(
        is_reference_like(expression).alias("reference_like"), F.coalesce(sql.isNotNull(), F.lit(False)).alias("understood"),
        unknown.alias("unknown"), sql.alias("spark_sql"),
        F.coalesce(written.getField("columns"), F.array().cast("array<struct<name: string, sql: string>>")).alias("columns"),
        F.when(plain, function.isNotNull()).otherwise(F.coalesce(written.getField("is_aggregate"), F.lit(False))).alias("is_aggregate"))


def is_understood(expression: Column) -> Column:
    """Every called name is known, and Spark parses the text that it is rewritten to."""
    return read(expression).getField("understood")


def to_spark_sql(expression: Column, aggregate: Column) -> Column:
    """Spark SQL text of an item, null where it is not understood."""
    return read(expression, aggregate).getField("spark_sql")
