"""Session settings, and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_RELEASE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark. A cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("starfold")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # call sites of each column: slow to build
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder. On a cluster that is an error: a folder
    that only one machine sees does not survive the loss of that machine.
    """
    folder = spark.conf.get(_CHECKPOINT_DIR, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_DIR} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="starfold-")
    spark.conf.set(_CHECKPOINT_DIR, folder)
    return folder


def materialize(df: DataFrame, label: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, pins values that two branches of one plan must agree on, and survives lost
    executors. Unlike a checkpoint, the written table can be pruned by column and has a known size. What the write has
    shuffled is released at its end, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_RELEASE_SHUFFLES, None)
    spark.conf.set(_RELEASE_SHUFFLES, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(_RELEASE_SHUFFLES, before) if before is not None else spark.conf.unset(_RELEASE_SHUFFLES)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` has written and that nothing reads any more."""
    for df in tables:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def materialize_all(frames: Mapping[str, DataFrame], label: str) -> dict[str, DataFrame]:
    """``materialize`` each of several frames that don't depend on each other, all at once, so that none waits for the last
    tasks of another."""
    if not frames:
        return {}
    spark = next(iter(frames.values())).sparkSession
    run = inheritable_thread_target(spark)(lambda name: materialize(frames[name], f"{label}-{name}"))
    with ThreadPoolExecutor(len(frames)) as pool:
        return dict(zip(frames, pool.map(run, frames)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
