"""Table sources: files, databases, empty placeholders and refreshable snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from starfold.functions.types import spark_type


@dataclass(frozen=True)
class ParquetSource:
    """Folder or file per table: ``<base>/<name>.parquet``."""

    base: str

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.base.rstrip('/')}/{name}.parquet")


@dataclass(frozen=True)
class JdbcSource:
    """Database behind a JDBC url. Give ``partition`` to read a table with many tasks.

    Fixed values: the default server, database and schema.
    """

    server: str = "localhost"
    database: str = "AdventureWorks"
    schema: str = "dbo"
    url_pattern: str = "jdbc:sqlserver://{server};databaseName={database}"
    partition: tuple[str, int, int, int] | None = None  # column, lower bound, upper bound, number of partitions

    def options(self, name: str) -> dict[str, str]:
        options = {
            "url": self.url_pattern.format(server=self.server, database=self.database),
            "dbtable": f"{self.schema}.{name}",
        }
        if self.partition:
            column, low, high, n = self.partition
            options |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high),
                        "numPartitions": str(n)}
        return options

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.format("jdbc").options(**self.options(name)).load()


@dataclass(frozen=True)
class EmptySource:
    """Typed tables without rows, for a model that has no physical source yet."""

    columns: dict[str, Sequence[tuple[str, str]]]  # table -> (column, source type name)

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        fields = [T.StructField(column, spark_type(type_name)) for column, type_name in self.columns[name]]
        return spark.createDataFrame([], T.StructType(fields))


def project_model_columns(df: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Physical columns under their model names: (source column, model name) pairs."""
    return df.select([F.col(source).alias(name) for source, name in columns])


def project_list(df: DataFrame, shown: Sequence[str]) -> DataFrame:
    """The shown columns in shown order; first occurrence wins, unknown names are dropped, none means all."""
    known = [name for name in dict.fromkeys(shown) if name in df.columns]
    return df.select(*known) if known else df


def _file_system(spark: SparkSession, path: str):
    """The store of a path, and the path in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the committed versions of a snapshot, oldest first."""
    store, folder = _file_system(spark, f"{path}/_versions")
    return sorted(f.getPath().getName() for f in store.listStatus(folder)) if store.exists(folder) else []


def refresh_snapshot(df: DataFrame, path: str, source_format: str = "parquet", keep: int = 2) -> DataFrame:
    """Replace the snapshot at ``path`` and read it back.

    Rows are written to a folder of their own; an entry of the next number in ``_versions`` then makes them the snapshot.
    Readers see the old table or the new one: a failed write leaves no entry, and of two refreshes at once the second to
    end is refused. The ``keep`` newest versions stay, so plans over the one before still run.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    known = _versions(spark, path)
    number = int(known[-1].partition("-")[0]) + 1 if known else 1
    name = f"{number:010d}-{uuid.uuid4().hex}"
    df.write.format(source_format).save(f"{path}/{name}")
    store, entry = _file_system(spark, f"{path}/_versions/{name}")
    # The number is taken by a file of that name alone, which only one writer can make.
    taken = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_numbers/{number:010d}")
    if not store.createNewFile(taken):
        raise ValueError(f"another refresh of {path} came first")
    store.create(entry, False).close()
    for old in _versions(spark, path)[:-keep]:
        for part in (f"{path}/_versions/{old}", f"{path}/{old}"):
            store.delete(spark._jvm.org.apache.hadoop.fs.Path(part), True)
    return read_snapshot(spark, path, source_format, df.schema)


def read_snapshot(spark: SparkSession, path: str, source_format: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """The newest committed version of a snapshot."""
    known = _versions(spark, path.rstrip("/"))
    if not known:
        raise FileNotFoundError(f"no snapshot at {path}")
    reader = spark.read.format(source_format)
    return (reader.schema(schema) if schema is not None else reader).load(f"{path.rstrip('/')}/{known[-1]}")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every table, in one result."""
    result = None
    for name, df in tables.items():
        counted = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        result = counted if result is None else result.unionByName(counted)
    return result
