"""What the data says about keys, references and cardinality, and the date dimension it needs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from starfold.plans.model import Relationship


def profile_keys(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows, nulls, uniqueness and key quality of the given columns of each table, all counted exactly.

    One pass per table: its columns become (column, value) rows, which are counted per value and then per column. All
    tables are parts of one plan. A column without values is not unique.
    """
    profiles = []
    for table, (df, columns) in tables.items():
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
                                    for c in columns]))
        per_value = df.select(cells.alias("cell")).groupBy("cell.column_name", "cell.value").agg(F.count(F.lit(1)).alias("n"))
        found = per_value.groupBy("column_name").agg(
            F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            (F.coalesce(F.max(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)) == 1).alias("unique"))
        names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column_name"))
        profiles.append(names.join(found, "column_name", "left").select(
            F.lit(table).alias("table_name"), "column_name", F.coalesce("n", F.lit(0)).alias("n_rows"),
            F.coalesce("nulls", F.lit(0)).alias("n_nulls"), F.coalesce("unique", F.lit(False)).alias("is_unique"),
            F.coalesce(F.col("unique") & (F.col("nulls") == 0), F.lit(False)).alias("is_key")))
    return reduce(DataFrame.unionByName, profiles)


def _common_type(one: DataFrame, a: str, other: DataFrame, b: str) -> str:
    """The type that Spark compares two columns in."""
    text = lambda df, c: f"cast(null as {df.schema[c].dataType.simpleString()})"
    return one.sparkSession.sql(f"select coalesce({text(one, a)}, {text(other, b)}) as c").schema["c"].dataType.simpleString()


def profile_references(tables: Mapping[str, DataFrame], relationships: Sequence[Relationship]) -> DataFrame:
    """Per relationship: rows, null keys, rows and keys without a match, and the cardinality found.

    Each table is read once: a row gives its key of every relationship it has an end in. Keys are counted per relationship
    and side before they meet, so a hot key costs one row a task. Keys are compared as text of their common type.
    """
    cells: dict[str, list] = {}
    for number, r in enumerate(relationships):
        many, one = tables[r.from_table], tables[r.to_table]
        kinds = [_common_type(many, a, one, b) for a, b in r.keys]
        for side, table, columns in (("many", r.from_table, [a for a, _ in r.keys]), ("one", r.to_table, [b for _, b in r.keys])):
            # Zero has one text only.
            values = [F.col(c).cast(t) + F.lit(0.0).cast(t) if t in ("double", "float") else F.col(c).cast(t) for c, t in zip(columns, kinds)]
            cells.setdefault(table, []).append(F.struct(
                F.lit(number).alias("number"), F.lit(side == "many").alias("is_many"), F.array(*[v.cast("string") for v in values]).alias("key")))
    # Each row of a table counts for each of its ends.
    ends = [tables[name].select(F.explode(F.array(*own)).alias("end")).groupBy("end.number", "end.key").agg(
        F.count_if("end.is_many").alias("n_many"), F.count_if(~F.col("end.is_many")).alias("n_one")) for name, own in cells.items()]
    both = reduce(DataFrame.unionByName, ends).groupBy("number", "key").agg(F.sum("n_many").alias("n_many"), F.sum("n_one").alias("n_one"))
    has_key = F.forall("key", lambda x: x.isNotNull())
    missing = has_key & (F.col("n_one") == 0)
    one_unique = F.coalesce(F.max(F.when(has_key, F.col("n_one"))), F.lit(0)) <= 1
    many_unique = F.coalesce(F.max(F.when(has_key, F.col("n_many"))), F.lit(0)) <= 1
    found = both.groupBy("number").agg(
        F.sum("n_many").alias("n_rows"), F.coalesce(F.sum(F.when(~has_key, F.col("n_many"))), F.lit(0)).alias("n_null_keys"),
        F.coalesce(F.sum(F.when(missing, F.col("n_many"))), F.lit(0)).alias("n_unmatched_rows"), F.count_if(missing & (F.col("n_many") > 0)).alias("n_unmatched_keys"),
        F.when(many_unique & one_unique, "1:1").when(one_unique, "n:1").when(many_unique, "1:n").otherwise("n:n").alias("cardinality"))
    zero = F.lit(0).cast("long")
    spark = next(iter(tables.values())).sparkSession
    names = spark.createDataFrame([(i, r.name) for i, r in enumerate(relationships)], "number int, relationship string")
    return names.join(found, "number", "left").select(
        "relationship", *[F.coalesce(c, zero).alias(c) for c in ("n_rows", "n_null_keys", "n_unmatched_rows", "n_unmatched_keys")],
        F.coalesce("cardinality", F.lit("1:1")).alias("cardinality"))


def date_dimension(dates: DataFrame, column: str) -> DataFrame:
    """One row per day from the first to the last date of a column."""
    span = dates.agg(F.min(column).cast("date").alias("first_day"), F.max(column).cast("date").alias("last_day"))
    days = span.filter("first_day is not null").select(
        F.explode(F.sequence("first_day", "last_day", F.expr("interval 1 day"))).alias("date"))
    return days.select(
        "date",
        F.year("date").cast("long").alias("year"),
        F.quarter("date").cast("long").alias("quarter"),
        F.month("date").cast("long").alias("month"),
        F.day("date").cast("long").alias("day"),
        F.date_format("date", "MMMM").alias("month_name"),
        (F.year("date") * 100 + F.month("date")).cast("long").alias("year_month"),
    )
