"""The semantic model over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from starfold.operators.profile import date_dimension
from starfold.plans.model import Measure, Model, Relationship, Table
from starfold.sources.tables import ParquetSource

PRICE = "cast(l_extendedprice as decimal(12,2))"
REVENUE = f"{PRICE} * (1 - cast(l_discount as decimal(12,2)))"

RELATIONSHIPS = [
    Relationship("line_order", "lineitem", "orders", [("l_orderkey", "o_orderkey")]),
    Relationship("line_part", "lineitem", "part", [("l_partkey", "p_partkey")]),
    Relationship("line_supplier", "lineitem", "supplier", [("l_suppkey", "s_suppkey")]),
    Relationship("order_customer", "orders", "customer", [("o_custkey", "c_custkey")]),
    Relationship("customer_nation", "customer", "nation", [("c_nationkey", "n_nationkey")]),
    Relationship("supplier_nation", "supplier", "nation", [("s_nationkey", "n_nationkey")]),
    Relationship("nation_region", "nation", "region", [("n_regionkey", "r_regionkey")]),
    Relationship("order_date", "orders", "dim_date", [("o_orderdate", "date")]),
    Relationship("ship_date", "lineitem", "dim_date", [("l_shipdate", "date")]),
    Relationship("event_customer", "events", "customer", [("user_id", "c_custkey")]),
]

MEASURES = [
    Measure("revenue", "lineitem", "sum", REVENUE, per_row=True),
    Measure("quantity", "lineitem", "sum", "l_quantity"),
    Measure("n_lines", "lineitem", "rowcount"),
    Measure("n_orders", "lineitem", "countdistinct", "l_orderkey"),
    Measure("avg_quantity", "lineitem", "average", "l_quantity"),
    Measure("order_value", "orders", "sum", "cast(o_totalprice as decimal(12,2))"),
    Measure("n_events", "events", "rowcount"),
    Measure("event_value", "events", "sum", "cast(value as decimal(12,2))"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ParquetSource(sf_dir).read(spark, name)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan spread over all cores, if the scan has fewer splits than there are cores.

    For rows that are costly to work on, such as definition files. With enough splits this does nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def retail_model(spark: SparkSession, sf_dir: str) -> Model:
    names = ["lineitem", "orders", "part", "supplier", "customer", "nation", "region", "events"]
    opener = lambda name: lambda: table(spark, sf_dir, name)
    tables = {name: Table(opener(name), is_fact=name in ("lineitem", "orders", "events")) for name in names}
    tables["lineitem"] = Table(
        opener("lineitem"), is_fact=True,
        calculated={"net_price": REVENUE, "price": PRICE, "discount": "cast(l_discount as decimal(12,2))"},
        hidden=["l_orderkey", "l_partkey", "l_suppkey"],
        summarize_by={"l_discount": "average", "l_tax": "max", "l_linenumber": "none", "l_suppkey": "distinctCount"},
    )
    tables["dim_date"] = Table(lambda: date_dimension(table(spark, sf_dir, "orders"), "o_orderdate"))
    return Model(tables, RELATIONSHIPS, MEASURES)


def as_double(df: DataFrame, *names: str) -> DataFrame:
    """Exact decimal results as doubles, for comparing."""
    return df.withColumns({name: F.col(name).cast("double") for name in names})


SQL_REVENUE = "cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(12,2)))"
