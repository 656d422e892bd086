"""Type names of definition files, as the six model types and as Spark types."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F, types as T

# Accepted source type names per model type.
TYPE_NAMES = {
    "dateTime": ["date", "datetime", "datetime2", "smalldatetime", "timestamp", "time"],
    "boolean": ["bool", "boolean", "bit"],
    "decimal": ["decimal", "numeric", "money", "smallmoney", "currency"],
    "double": ["double", "float", "float64", "real", "number"],
    "int64": ["int", "integer", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64",
              "bigint", "smallint", "tinyint", "mediumint", "unsignedint", "long", "short", "byte", "serial"],
}

# Numeric type codes of report data items.
TYPE_CODES = {
    "1": "int64", "2": "int64", "3": "string", "4": "dateTime", "5": "dateTime",
    "7": "dateTime", "8": "dateTime", "9": "decimal", "10": "double",
}

DEFAULT_DECIMAL = T.DecimalType(18, 2)


def type_base(type_name: Column) -> Column:
    """``Decimal(18, 2)`` -> ``decimal``."""
    return F.trim(F.split_part(F.lower(F.trim(type_name)), F.lit("("), F.lit(1)))


def _lookup(pairs: dict[str, str]) -> Column:
    """Literal map, built in one call."""
    return F.expr("map(" + ", ".join(f"'{key}', '{value}'" for key, value in pairs.items()) + ")")


def normalize_type(type_name: Column) -> Column:
    """Model type of a source type name. Unknown, empty and null names are strings."""
    model_types = {name: model_type for model_type, names in TYPE_NAMES.items() for name in names}
    return F.coalesce(F.try_element_at(_lookup(model_types), type_base(type_name)), F.lit("string"))


def type_of_code(code: Column) -> Column:
    """Model type of a numeric type code, null for other codes."""
    return F.try_element_at(_lookup(TYPE_CODES), F.trim(code))


def spark_type(type_name: str | None) -> T.DataType:
    """Spark type of one source type name; decimal precision is kept, dates stay dates."""
    base, _, rest = (type_name or "").strip().lower().partition("(")
    base = base.strip()
    model_type = next((m for m, names in TYPE_NAMES.items() if base in names), "string")
    if model_type == "decimal":
        digits = [int(n) for n in re.findall(r"\d+", rest)]
        return T.DecimalType(digits[0], digits[1] if len(digits) > 1 else 0) if digits else DEFAULT_DECIMAL
    if model_type == "dateTime":
        return T.DateType() if base == "date" else T.TimestampNTZType()
    return {"boolean": T.BooleanType(), "double": T.DoubleType(), "int64": T.LongType()}.get(
        model_type, T.StringType()
    )


def cast_to(value: Column, type_name: str) -> Column:
    """Coerce ``value``; what cannot be read as the type becomes null instead of failing the job."""
    return value.try_cast(spark_type(type_name))
