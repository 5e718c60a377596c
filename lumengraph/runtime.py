"""Session helpers shared by every operator: durable intermediate tables and table access."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Taken from ``spark.checkpoint.dir``. Where that is unset a local master gets a folder of its
    own; a cluster is refused, because its machines do not share a local disk.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints/lumengraph"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if it is there too."""
    root = str(Path(__file__).resolve().parent.parent)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{paths}:{root}".strip(":")


#: Folders of intermediate tables that this process has written and not discarded, oldest first.
_written: list[str] = []


def durable(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read and not a recomputation. The folder goes
    when it is discarded, or when the session's JVM ends. Options are the Parquet writer's.
    """
    spark = df.sparkSession
    prepare(spark)
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _written.append(path)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared one, for what a query keeps while the session lasts."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written() -> list[str]:
    """The folders of intermediate tables so far."""
    return list(_written)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes intermediate tables that nothing reads any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        _written.remove(path)


def dealt(df: DataFrame, *columns: str, rows: int = 0) -> DataFrame:
    """`df` dealt by columns over as many tasks as a shuffle has, more beyond a million of `rows` for each.

    Small rows of many are merged into few tasks by their size when shuffled, and there take many times
    that in memory. The number given here stays. A grouping or join by these columns needs no other shuffle.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, rows // 1_000_000 + 1), *columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables by name."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
