"""Relationship joins.

No join here is forced to broadcast: Spark broadcasts a side when its own size estimate is below
``spark.sql.autoBroadcastJoinThreshold``, adaptive execution checks again with the real size, and larger
sides are shuffled with skewed partitions split.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from starfold.operators.windows import in_ranges, range_offsets, with_offsets
from starfold.plans.model import full_join, semi_filter
from starfold.session import materialize, shuffle_partitions

Keys = Sequence[tuple[str, str]]

_QUANTILE_ERROR = 0.001
_FEW_ROWS = 200_000  # rows of a side of an inequality join that every task gets
_PAIRS = 1 << 25  # pairs that such a task looks at, so that what it groups stays small


def _matches(left: DataFrame, right: DataFrame, keys: Keys) -> Column:
    if not keys:
        raise ValueError("an equality is needed; inequality_join does without")
    return reduce(Column.__and__, [left[a] == right[b] for a, b in keys])


def many_to_one(fact: DataFrame, dim: DataFrame, keys: Keys) -> DataFrame:
    """Every fact row once, with the columns of its one dimension row or nulls."""
    return fact.join(dim, _matches(fact, dim, keys), "left")


def duplicate_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their row count."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def one_to_one(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Full join of two tables whose keys are both unique; refuses keys that are not."""
    for df, columns in ((left, [a for a, _ in keys]), (right, [b for _, b in keys])):
        if not duplicate_keys(df.dropna(subset=columns), columns).isEmpty():
            raise ValueError(f"not a 1:1 relationship: {columns} has duplicates")
    return left.join(right, _matches(left, right, keys), "full")


def role_playing(fact: DataFrame, dim: DataFrame, roles: dict[str, Keys]) -> DataFrame:
    """Join one dimension once per role; its columns get the role as prefix."""
    for role, keys in roles.items():
        played = dim.select([F.col(c).alias(f"{role}_{c}") for c in dim.columns])
        fact = many_to_one(fact, played, [(a, f"{role}_{b}") for a, b in keys])
    return fact


def flatten_dimension(dim: DataFrame, hops: Sequence[tuple[DataFrame, Keys]]) -> DataFrame:
    """One wide dimension from a snowflake chain."""
    for parent, keys in hops:
        dim = many_to_one(dim, parent, keys)
    return dim


def drill_across(results: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Join results that are already aggregated to the grain ``by``. Raw facts never meet."""
    return reduce(lambda left, right: full_join(left, right, by), results)


def through_bridge(rows: DataFrame, bridge: DataFrame, members: DataFrame, row_keys: Keys, member_keys: Keys
                   ) -> DataFrame:
    """Rows that reach at least one of ``members`` through a bridge table.

    ``row_keys`` are (row, bridge) pairs and ``member_keys`` (bridge, member) pairs. Semi joins: a row
    with several matching members still counts once.
    """
    return semi_filter(rows, semi_filter(bridge, members, member_keys), row_keys)


def _bounds(df: DataFrame, value: str, n: int) -> list[float]:
    """Borders of ``n`` bins of about as many values each. The estimate only balances the bins."""
    return sorted(set(df.approxQuantile(value, [i / n for i in range(1, n)], _QUANTILE_ERROR))) if n > 1 else []


def _bin(value: Column, bounds: Sequence[float]) -> Column:
    """The number of borders at or below a value, found by halving: a tree of comparisons as deep as log2 of their number."""
    def halves(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(bounds[middle]), halves(low, middle)).otherwise(halves(middle + 1, high))

    return F.when(value.isNotNull(), halves(0, len(bounds)))


# The comparisons of an inequality join, each with the same one seen from the other side.
_TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def inequality_join(left: DataFrame, right: DataFrame, conditions: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Inner join on one or two inequalities of numeric columns, and no equality: (left column, comparison, right column).

    Left values are cut into bins, a grid of about as many cells as there are shuffle partitions. A right row meets the
    cells that its comparisons can reach; a cell that lies in reach as a whole matches without a look, so comparisons are
    only lost in the cells on the border. The join itself is an equality of cells, which Spark sorts and can split.

    The work is in the pairs, which the bytes of the two sides don't tell: tasks are not put together by size. If a side has
    few rows, counted first, every task gets all of them, and the other side is dealt evenly: all pairs of a row come from
    one task, one after the other.
    """
    if not 1 <= len(conditions) <= 2 or any(c not in _TURNED for _, c, _ in conditions):
        raise ValueError("one or two of <, <=, >, >= are needed")
    columns = [*left.columns, *right.columns]
    for a, _, b in conditions:
        left, right = left.filter(F.col(a).isNotNull()), right.filter(F.col(b).isNotNull())
    n_left, n_right = left.count(), right.count()
    if n_right < n_left and n_right <= _FEW_ROWS:
        left, right, n_left = right, left, n_right
        conditions = [(b, _TURNED[c], a) for a, c, b in conditions]
    spark = left.sparkSession
    tasks, few = shuffle_partitions(spark), n_left <= _FEW_ROWS
    if few:
        dealt = max(tasks, 8 * spark.sparkContext.defaultParallelism, min(n_left * n_right // _PAIRS, 10_000))
        right = right.repartition(dealt)
    n = max(int(tasks ** 0.5), 8 * few, 1) if len(conditions) == 2 else tasks
    match, checks = F.lit(True), F.lit(True)
    for i, (a, comparison, b) in enumerate(conditions):
        bounds = _bounds(left, a, n)
        left = left.withColumn(f"left_bin_{i}", _bin(F.col(a), bounds))
        own = _bin(F.col(b), bounds)
        reach = F.sequence(F.lit(0), own) if comparison in ("<", "<=") else F.sequence(own, F.lit(len(bounds)))
        right = right.withColumn(f"own_bin_{i}", own).withColumn(f"right_bin_{i}", F.explode(reach))
        match = match & (F.col(f"left_bin_{i}") == F.col(f"right_bin_{i}"))
        checks = checks & ((F.col(f"own_bin_{i}") != F.col(f"right_bin_{i}")) | F.expr(f"`{a}` {comparison} `{b}`"))
    if few:
        left = F.broadcast(left)
    else:
        bins = lambda side: [f"{side}_bin_{i}" for i in range(len(conditions))]
        left, right = left.repartition(tasks, *bins("left")), right.repartition(tasks, *bins("right"))
    return right.join(left, match & checks).select(*[f"`{c}`" for c in columns])


def interval_join(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str]) -> DataFrame:
    """Inner join of half-open intervals that overlap: each of ``left_ends`` and ``right_ends`` is (low, high).

    The line is cut at estimated quantiles of the lower ends; an interval stands in each piece that it touches, and a pair
    is given in the piece where the later of the two begins, so once. Empty intervals and those with a null end overlap
    nothing.
    """
    (a, b), (c, d) = left_ends, right_ends
    left, right = left.filter(F.col(a) < F.col(b)), right.filter(F.col(c) < F.col(d))
    starts = left.select(F.col(a).cast("double").alias("low")).unionByName(right.select(F.col(c).cast("double").alias("low")))
    bounds = _bounds(starts, "low", shuffle_partitions(left.sparkSession))
    place = lambda df, low, high, side: df.withColumn(f"{side}_first", _bin(F.col(low), bounds)).withColumn(
        f"{side}_piece", F.explode(F.sequence(F.col(f"{side}_first"), _bin(F.col(high), bounds))))
    match = (F.col("left_piece") == F.col("right_piece")) & (F.col("left_piece") == F.greatest("left_first", "right_first"))
    overlap = (F.col(a) < F.col(d)) & (F.col(c) < F.col(b))
    return place(left, a, b, "left").join(place(right, c, d, "right"), match & overlap).drop(
        "left_first", "left_piece", "right_first", "right_piece")


def band_join(rows: DataFrame, bands: DataFrame, value: str, low: str, high: str) -> DataFrame:
    """Inner join on ``low <= value < high`` for numeric columns.

    Both sides are cut into bins between estimated quantiles of the values, as many as there are shuffle partitions, so
    the join is an equi-join on the bin with the range as residual condition. Bins hold about as many rows each, and a
    band is repeated once for each bin that it touches, however wide it is. The estimate only balances the bins. To
    aggregate by band, ``band_totals`` needs no pairs of rows and bands.
    """
    bounds = _bounds(rows, value, shuffle_partitions(rows.sparkSession))
    bin_of = lambda c: _bin(F.col(c), bounds)
    binned = bands.filter(F.col(low) < F.col(high)).withColumns({"first_bin": bin_of(low), "last_bin": bin_of(high)})
    binned = binned.withColumn("band_bin", F.explode(F.sequence("first_bin", "last_bin"))).drop("first_bin", "last_bin")
    keyed = rows.filter(F.col(value).isNotNull()).withColumn("row_bin", bin_of(value))
    match = (keyed["row_bin"] == binned["band_bin"]) & (keyed[value] >= binned[low]) & (keyed[value] < binned[high])
    return keyed.join(binned, match, "inner").drop("row_bin", "band_bin")


def band_totals(rows: DataFrame, bands: DataFrame, value: str, low: str, high: str, totals: Mapping[str, str]) -> DataFrame:
    """``bands`` with ``n_rows`` and totals of the rows with ``low <= value < high``.

    The difference of two running totals over the distinct values, looked up at either end of a band. Ends and values lie
    in one order, so a lookup is a running total too, and work grows with rows and bands, not with their pairs.
    ``totals`` maps an output name to a column; a band that holds no row has 0 rows and null totals.
    """
    names = list(totals)
    bands = materialize(bands.withColumn("band_no", F.monotonically_increasing_id()), "bands")
    at_value = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("at")).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.sum(c).alias(n) for n, c in totals.items()])
    empty = [F.lit(None).cast(at_value.schema[n].dataType).alias(n) for n in ["n_rows", *names]]
    ends = bands.filter(F.col(low) < F.col(high)).select("band_no", F.explode(F.array(
        F.struct(F.col(low).alias("at"), F.lit(-1).alias("sign")), F.struct(F.col(high).alias("at"), F.lit(1).alias("sign")))).alias("end"))
    ends = ends.select("end.at", "band_no", "end.sign", *empty)
    line = at_value.select("at", F.lit(None).cast("long").alias("band_no"), F.lit(None).cast("int").alias("sign"),
                           "n_rows", *names).unionByName(ends)
    # An end comes before the value that equals it: what lies below the end is counted.
    order = [F.col("at"), F.col("band_no").isNull()]
    ranged = in_ranges(line, [], [F.col("at")])
    offsets = range_offsets(ranged, [], {f"before_{n}": F.sum(n) for n in ["n_rows", *names]})
    placed = with_offsets(ranged, offsets, [])
    w = Window.partitionBy("range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    below = [(F.coalesce(F.sum(n).over(w), F.lit(0)) + F.col(f"before_{n}")).alias(n) for n in ["n_rows", *names]]
    found = placed.select("band_no", "sign", *below).filter("band_no is not null")
    summed = found.groupBy("band_no").agg(*[F.sum(F.col("sign") * F.col(n)).alias(n) for n in ["n_rows", *names]])
    joined = bands.join(summed, "band_no", "left").drop("band_no")
    some = F.col("n_rows") > 0
    return joined.withColumns({"n_rows": F.coalesce("n_rows", F.lit(0)), **{n: F.when(some, F.col(n)) for n in names}})


def theta_join(left: DataFrame, right: DataFrame, keys: Keys, condition: str, how: str = "inner") -> DataFrame:
    """Equality on ``keys`` plus any further condition over both sides' columns."""
    return left.join(right, _matches(left, right, keys) & F.expr(condition), how)


def _edges(members: DataFrame, key: str, parent: str, *more: Column) -> DataFrame:
    """Members as node, parent and ``up``, the parent if it is another member; refuses repeated members."""
    edges = materialize(members.select(F.col(key).alias("node"), F.col(parent).alias("parent"), *more), "members")
    if not duplicate_keys(edges.filter("node is not null"), ["node"]).isEmpty():
        raise ValueError(f"not a hierarchy: {key} has repeated members")
    present = edges.filter("node is not null").select(F.col("node").alias("known"))
    # A member without a key is nobody's parent, and a root.
    edges = edges.withColumn("parent", F.when(F.coalesce(F.col("parent") != F.col("node"), F.lit(False)), F.col("parent")))
    return edges.join(present, F.col("parent") == F.col("known"), "left").withColumnRenamed("known", "up")


def hierarchy_paths(members: DataFrame, key: str, parent: str, separator: str = "|") -> DataFrame:
    """Path from the root, level and root of every member of a parent-child table of any depth.

    A member without a parent, with itself as parent, or with a parent that does not exist, is a root, and so is one
    without a key. Members on or behind a cycle are kept, with nulls. Repeated members are refused.

    Pointers double: each round, a member takes over the way of the ancestor that it has come to, so a chain of n
    members needs log(n) rounds. A round that finishes no member leaves only cycles.
    """
    is_root = F.col("up").isNull()
    current = materialize(_edges(members, key, parent).select(
        "node", "parent", "up", F.col("node").cast("string").alias("path"), F.lit(1).alias("level"),
        F.when(is_root, F.col("node")).alias("root"), is_root.alias("reached")), "hierarchy")
    n_open = current.filter("not reached").count()
    while n_open:
        above = current.filter("node is not null").select(
            F.col("node").alias("above"), *[F.col(c).alias(f"above_{c}") for c in ("up", "path", "level", "root", "reached")])
        moved = current.filter("not reached").join(above, F.col("up") == F.col("above")).select(
            "node", "parent", F.col("above_up").alias("up"), F.concat_ws(separator, "above_path", "path").alias("path"),
            (F.col("above_level") + F.col("level")).alias("level"), F.col("above_root").alias("root"), F.col("above_reached").alias("reached"))
        current = materialize(current.filter("reached").unionByName(moved), "hierarchy")
        before, n_open = n_open, current.filter("not reached").count()
        if n_open == before:
            break
    reached = lambda c: F.when(F.col("reached"), F.col(c)).alias(c)
    return current.select("node", "parent", reached("path"), reached("level"), "root")


def hierarchy_totals(members: DataFrame, key: str, parent: str, totals: Mapping[str, str]) -> DataFrame:
    """For every member, how many members its subtree has, itself included, and totals over it; any depth.

    ``totals`` maps an output name to a column of ``members``; nulls count as nothing. Roots, members without a key and cycles
    are as in ``hierarchy_paths``. Each round doubles the depth that totals reach: what lies less than 2d below a member is
    what lies less than d below it, and below each of those that stand d below it. A hot parent is summed in every task first.
    """
    names = ["n_members", *totals]
    own = [F.col(c).alias(n) for n, c in totals.items()]
    current = materialize(_edges(members, key, parent, *own).select(
        "node", "parent", "up", F.lit(1).cast("long").alias("n_members"), *totals), "totals")
    n_open = current.filter("up is not null").count()
    while n_open:
        lifted = current.filter("up is not null").groupBy(F.col("up").alias("to")).agg(*[F.sum(n).alias(f"below_{n}") for n in names])
        above = current.filter("node is not null").select(F.col("node").alias("above"), F.col("up").alias("further"))
        # In ordinary SQL sums, null and a number is the number.
        add = lambda n: F.coalesce(F.col(n) + F.col(f"below_{n}"), F.col(n), F.col(f"below_{n}")).alias(n)
        current = materialize(current.join(lifted, F.col("node") == F.col("to"), "left").join(above, F.col("up") == F.col("above"), "left").select(
            "node", "parent", F.col("further").alias("up"), *[add(n) for n in names]), "totals")
        before, n_open = n_open, current.filter("up is not null").count()
        if n_open == before:
            break
    reached = lambda c: F.when(F.col("up").isNull(), F.col(c)).alias(c)
    return current.select("node", "parent", *[reached(n) for n in names])
