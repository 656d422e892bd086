"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from starfold.session import shared_folder


class Scratch:
    """Tables of one run of an operator, in a folder of its own below ``spark.checkpoint.dir``.

    A written table cuts the lineage and survives lost executors. A table is dropped as soon as nothing reads it
    any more; those that the result reads stay until the folder is cleared.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        found.scratch_path = path
        return found

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
