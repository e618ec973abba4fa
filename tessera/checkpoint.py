"""Lineage cuts that survive lost executors: tables in the folder that all machines share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only in local mode, where one machine holds all, a folder of our own if it is unset."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not path and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(path or "/tmp/tessera-checkpoints")
        current = context._jsc.sc().getCheckpointDir()
    return path or current.get()


def fresh(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, which goes when the application ends."""
    path = f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut(frame: DataFrame, label: str = "step") -> DataFrame:
    """Write the frame to the shared folder and read it again: the plan starts anew there."""
    path = fresh(frame.sparkSession, label)
    frame.write.parquet(path)
    return stored(frame, path)


def counted(frame: DataFrame, label: str, **sums) -> tuple[DataFrame, dict]:
    """cut(), and aggregates of the rows taken while they are written."""
    seen, path = Observation(), fresh(frame.sparkSession, label)
    frame.observe(seen, *[c.alias(n) for n, c in sums.items()]).write.parquet(path)
    return stored(frame, path), seen.get


def stored(frame: DataFrame, path: str) -> DataFrame:
    """What was written of the frame to the path, with the frame's schema."""
    out = frame.sparkSession.read.schema(frame.schema).parquet(path)
    out.tessera_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables that cut() gave and that nothing reads any more; frames of other origin stay."""
    for frame in frames:
        path = getattr(frame, "tessera_path", None)
        if path:
            spark = frame.sparkSession
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of plans that nothing holds any more; it learns of them when the driver's JVM collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
