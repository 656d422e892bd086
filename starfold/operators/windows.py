"""Running measures, ranks and exact percentiles over data of any size.

A window without partitions, or with one hot partition, would sort everything in one task. Here the rows
are range-partitioned by the order, each range is numbered and written out, ranges are summed, and every
row adds the total of the ranges before its own. Only one range at a time is sorted in a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from starfold.session import materialize, shuffle_partitions


def in_ranges(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """Add ``range_no``: rows of a lower range come first, and equal rows share a range."""
    n = shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *[F.col(c) for c in partition_by], *order_by)
    return materialize(ranged.withColumn("range_no", F.spark_partition_id()), "ranges")


def range_offsets(ranged: DataFrame, partition_by: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """Per partition and range, the totals of all earlier ranges of that partition."""
    sums = ranged.groupBy(*partition_by, "range_no").agg(*[c.alias(name) for name, c in totals.items()])
    # At most one row per range in each partition, so this window stays small.
    earlier = Window.partitionBy(*partition_by).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*[F.col(c).alias(f"of_{c}") for c in [*partition_by, "range_no"]],
                       *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in totals])


def with_offsets(ranged: DataFrame, offsets: DataFrame, partition_by: Sequence[str], how: str = "left") -> DataFrame:
    match = F.col("range_no") == F.col("of_range_no")
    for c in partition_by:
        match = match & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return ranged.join(offsets, match, how).drop(*[f"of_{c}" for c in [*partition_by, "range_no"]])


def running(df: DataFrame, order_by: Sequence[str], totals: Mapping[str, str] | None = None,
            counts: Mapping[str, str] | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """Running totals and counts up to and including each row.

    ``totals`` and ``counts`` map an output name to its column. The order has to be unique within a
    partition, as the running values of tied rows would be arbitrary: ties end the query. Equal rows share a range,
    so the window that numbers them sees every tie.
    """
    totals, counts = totals or {}, counts or {}
    by = [*partition_by, *order_by]
    ranged = in_ranges(df, partition_by, [F.col(c) for c in order_by])
    sums = {f"before_{n}": F.sum(c) for n, c in totals.items()}
    sums |= {f"before_{n}": F.count(c) for n, c in counts.items()}
    rows = with_offsets(ranged, range_offsets(ranged, partition_by, sums), partition_by)
    w = Window.partitionBy(*partition_by, "range_no").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    added = [(F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"before_{n}")).alias(n) for n, c in totals.items()]
    added += [(F.count(c).over(w) + F.col(f"before_{n}")).alias(n) for n, c in counts.items()]
    place = F.struct(*[F.col(c) for c in order_by])
    previous = F.lag(place).over(Window.partitionBy(*partition_by, "range_no").orderBy(*order_by))
    refusal = F.raise_error(F.lit(f"running measures need a unique order; {by} has ties"))
    first, *others = added
    name = [*totals, *counts][0]
    checked = F.when(previous.eqNullSafe(place), refusal).otherwise(first).alias(name)
    return rows.select(*df.columns, checked, *others)


def rank(df: DataFrame, value: str, name: str = "rank", descending: bool = True,
         partition_by: Sequence[str] = ()) -> DataFrame:
    """Rank by a value; equal values share a rank, and the next rank skips. Nulls come last.

    Ranks are computed over distinct values with their row counts, so many ties cost nothing.
    """
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    counted = df.groupBy(*partition_by, value).agg(F.count(F.lit(1)).alias("n_rows"))
    ranged = in_ranges(counted, partition_by, [order])
    rows = with_offsets(ranged, range_offsets(ranged, partition_by, {"before": F.sum("n_rows")}), partition_by)
    w = Window.partitionBy(*partition_by, "range_no").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    position = F.coalesce(F.sum("n_rows").over(w), F.lit(0)) + F.col("before") + 1
    ranks = rows.select(*[F.col(c).alias(f"of_{c}") for c in [*partition_by, value]], position.alias(name))
    match = F.col(value).eqNullSafe(F.col(f"of_{value}"))
    for c in partition_by:
        match = match & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return df.join(ranks, match, "left").select(*df.columns, name)


_SKETCH = 10_000  # a sketch of this accuracy is off by one rank in so many at most
_WHOLE = 10 * _SKETCH  # groups of fewer values are not worth a sketch


def percentiles(df: DataFrame, value: str, fractions: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated percentiles per group, one column per named fraction. Nulls are left out.

    A mergeable sketch brackets each position. One more pass counts the values between the brackets, and keeps only those
    inside, so a small share of a large group is sorted, and that in ranges over all tasks. If a sketch should ever miss a
    position, its counts show it, and the groups are ranged whole.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("at"))
    probes = [x for f in fractions.values() for x in (max(f - 3 / _SKETCH, 0.0), min(f + 3 / _SKETCH, 1.0))]
    sketch = rows.groupBy(*[F.col(c).alias(f"of_{c}") for c in by]).agg(
        F.count(F.lit(1)).alias("n_group"), F.min("at").alias("least"), F.max("at").alias("most"),
        F.percentile_approx("at", probes, _SKETCH).alias("probes"))
    brackets = materialize(sketch.select(
        *[f"of_{c}" for c in by], "n_group",
        *[F.when(F.col("n_group") < _WHOLE, F.col("least")).otherwise(F.get("probes", F.lit(2 * i))).alias(f"low_{i}") for i in range(len(fractions))],
        *[F.when(F.col("n_group") < _WHOLE, F.col("most")).otherwise(F.get("probes", F.lit(2 * i + 1))).alias(f"high_{i}") for i in range(len(fractions))]),
        "brackets")
    found = materialize(_selected(rows, brackets, fractions, by), "percentiles")
    if not found.filter("missed").isEmpty():
        whole = brackets.select(*[f"of_{c}" for c in by], "n_group", *[F.lit(None).cast(brackets.schema[f"{end}_{i}"].dataType).alias(f"{end}_{i}")
                                                                      for end in ("low", "high") for i in range(len(fractions))])
        found = _selected(rows, whole, fractions, by)
    return found.drop("missed")


def _selected(rows: DataFrame, brackets: DataFrame, fractions: Mapping[str, float], by: Sequence[str]) -> DataFrame:
    """Percentiles from the values inside the brackets, a null bracket having no end, and ``missed`` where one is not there."""
    match = F.lit(True)  # without groups, one row of brackets meets all
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    joined = rows.join(brackets, match)
    # How many brackets have begun, and have ended: both only grow with the value, and differ inside of one.
    begun = sum((F.coalesce(F.col("at") >= F.col(f"low_{i}"), F.lit(True)).cast("int") for i in range(len(fractions))), F.lit(0))
    ended = sum((F.coalesce(F.col("at") > F.col(f"high_{i}"), F.lit(False)).cast("int") for i in range(len(fractions))), F.lit(0))
    counted = joined.withColumns({"place": begun + ended, "at": F.when(begun > ended, F.col("at"))}).groupBy(
        *by, "n_group", "place", "at").agg(F.count(F.lit(1)).alias("n_rows"))
    ranged = in_ranges(counted, by, [F.col("place"), F.col("at")])
    held = with_offsets(ranged, range_offsets(ranged, by, {"before": F.sum("n_rows")}), by)
    w = Window.partitionBy(*by, "range_no").orderBy("place", "at").rowsBetween(Window.unboundedPreceding, 0)
    # A value covers the row positions [first, last] of its group, counted from 0.
    held = held.withColumn("last", F.sum("n_rows").over(w) + F.col("before") - 1)
    held = held.withColumn("first", F.col("last") - F.col("n_rows") + 1)
    results, missed = [], F.lit(False)
    for name, fraction in fractions.items():
        position = F.lit(float(fraction)) * (F.col("n_group") - 1)
        holds = lambda p: (F.col("first") <= p) & (p <= F.col("last"))
        low = F.max(F.when(holds(F.floor(position)), F.col("at")))
        high = F.max(F.when(holds(F.ceil(position)), F.col("at")))
        share = F.max(position - F.floor(position))
        results.append((low + (high - low) * share).alias(name))
        missed = missed | low.isNull() | high.isNull()
    return held.groupBy(*by).agg(*results, missed.alias("missed"))
