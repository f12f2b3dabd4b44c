"""Session settings and lineage cutting."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession


def builder(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession.Builder:
    """A session builder with the settings the operators are written for.

    Timestamps are compared in UTC, adaptive execution splits skewed join
    partitions and merges small ones.  On a cluster the master, memory and
    ``spark.checkpoint.dir`` come from the submit configuration.
    """
    b = (
        SparkSession.builder.appName("seedloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; a local one only where none is set."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="seedloom-ckpt-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(named)


#: Paths that this process has written below a checkpoint folder.
_written: list[str] = []


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the checkpoint folder, for tables that cut lineage."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    _written.append(f"{root}/{label}-{uuid.uuid4().hex}")
    return _written[-1]


def clear_cuts(spark: SparkSession) -> int:
    """Remove every table that ``cut`` has written in this process; returns how many.

    For a caller that has written its result: frames that were built on these tables can no longer be read.
    """
    n = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Unlike ``checkpoint()`` this writes compressed columns, so later steps
    read only the columns they need; a lost executor loses nothing.  The table stays until ``clear_cuts``.
    """
    path = shared_dir(df.sparkSession, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shuffles(plan: JavaObject) -> bool:
    """Whether rows of a physical plan go through a shuffle; sides that are broadcast do not count."""
    name = plan.getClass().getSimpleName()
    if name == "ShuffleExchangeExec":
        return True
    if name == "AdaptiveSparkPlanExec":
        return _shuffles(plan.initialPlan())
    if name == "BroadcastExchangeExec":
        return False
    children = plan.children()
    return any(_shuffles(children.apply(i)) for i in range(children.size()))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files are fewer: before costly work a row on a table that is one small file.

    Larger tables have more splits than cores and stay as they are; so does what comes
    out of a shuffle, whose partitions are not known before it has run.
    """
    if _shuffles(df._jdf.queryExecution().executedPlan()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def input_splits(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the unit for explicit repartitioning."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(str(Path(sf_dir) / f"{name}.parquet") if "://" not in sf_dir else f"{sf_dir}/{name}.parquet")
