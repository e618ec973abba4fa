"""Structured Streaming twins of the stream operators."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tessera.checkpoint import shared_dir
from tessera.operators import sketch


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, length: str, slide: str, late: str = "1 hour") -> DataFrame:
    """(event_type, start_us, n, total) of sliding windows; events later than the watermark are dropped."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select("event_type", F.unix_micros("window.start").alias("start_us"), "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """(user_id, start_us, n) of sessions without a gap."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


def first_seen(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Events without later copies inside the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what its source holds now; its result table.

    Batches go to the shared folder through foreachBatch: complete results
    replace each other, appended ones add up, and a batch that is run again
    overwrites its own folder, so each counts once.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/tessera-live-{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    last = {"epoch": None}

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")
        last["epoch"] = epoch

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if last["epoch"] is None:
        return spark.createDataFrame([], stream.schema)
    out = spark.read.schema(stream.schema)
    return out.parquet(f"{base}/out/epoch={last['epoch']}" if mode == "complete" else f"{base}/out/*")


def sketched(spark: SparkSession, events: DataFrame, key: str, eps: float = 0.001, delta: float = 0.01) -> DataFrame:
    """A Count-Min table of a stream: each batch's table is written on its own and all are summed when read."""
    base = f"{shared_dir(spark)}/tessera-live-cms-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)

    def write(batch: DataFrame, epoch: int) -> None:
        sketch.count_min(batch, key, eps, delta).write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    events.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("row int, col int, n long").parquet(f"{base}/out/*").groupBy("row", "col").agg(F.sum("n").alias("n"))


def trailing(events: DataFrame, hours: float, late: float = 1.0, peers: bool = False) -> DataFrame:
    """(event_type, event_id, n, total) over (t - hours, t] of each event type, as events arrive.

    Events of a batch go by time and id; with `peers`, events of equal time that
    have arrived all count each other.  State is the events of the last
    hours + late before the newest event, so one that comes up to `late` hours
    after newer ones still finds its whole window; what it changes in the counts
    of those newer ones is not told again (append mode).  An event without a
    value counts and adds nothing; the total of no value is null.
    """
    size, kept = int(hours * 3_600_000_000), int((hours + late) * 3_600_000_000)

    def step(key, batches, state):
        old, values = state.get if state.exists else ([], [])
        rows = pd.concat(list(batches))
        times = np.concatenate((np.array(old, np.int64), rows["us"].to_numpy(np.int64)))
        values = np.concatenate((np.array(values, float), rows["value"].to_numpy(float)))
        ids = np.concatenate((np.full(len(old), np.iinfo(np.int64).min), rows["event_id"].to_numpy(np.int64)))  # ties: earlier batches first
        fresh = np.arange(len(times)) >= len(old)
        order = np.lexsort((ids, times))
        times, values, ids, fresh = times[order], values[order], ids[order], fresh[order]
        valued = np.concatenate(([0], np.cumsum(~np.isnan(values))))
        sums = np.concatenate(([0.0], np.cumsum(np.nan_to_num(values).astype(np.longdouble))))  # long doubles: what is left of a long sum is small
        first = np.searchsorted(times, times - size, side="right")
        place = np.searchsorted(times, times, side="right") if peers else np.arange(len(times)) + 1
        state_from = np.searchsorted(times, times[-1] - kept, side="right") if len(times) else 0
        state.update((times[state_from:].tolist(), values[state_from:].tolist()))
        total = pd.Series((sums[place] - sums[first]).astype(float)).where(valued[place] > valued[first])
        yield pd.DataFrame({"event_type": key[0], "event_id": ids[fresh], "n": (place - first)[fresh], "total": total[fresh].to_numpy()})

    rows = events.select("event_type", "event_id", F.unix_micros("ts").alias("us"), "value")
    return rows.groupBy("event_type").applyInPandasWithState(step, "event_type string, event_id long, n long, total double", "times array<long>, values array<double>", "append", GroupStateTimeout.NoTimeout)
