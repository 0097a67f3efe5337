"""Event streams: debounced jobs per key, and windows over late data.

A source is a folder of Parquet files; `available` reads what is there and stops, so the
same functions serve a drain run and a long-running one (give another trigger).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarkash.sources import tables

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a stream's output and progress, in the session's shared folder."""
    return f"{tables.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_events(spark: SparkSession, sf_dir: str, files_per_batch: int = 64) -> DataFrame:
    """The events table as a stream, with `ts` as a timestamp."""
    source = spark.readStream.schema(EVENTS).format("parquet").option("maxFilesPerTrigger", files_per_batch)
    one = [f for f in spark.read.parquet(f"{sf_dir}/events.parquet").inputFiles() if f.endswith("/events.parquet")]  # a stream reads folders only
    stream = source.option("pathGlobFilter", "events.parquet").load(sf_dir) if one else source.load(f"{sf_dir}/events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there; each batch's whole result replaces the one before. Returns the last.

    The batch's folder is named by its number, so a batch that is run again overwrites its own.
    """
    spark = stream.sparkSession

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/{batch}")
        write.last = batch

    write.last = None
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    if write.last is None:
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(f"{folder}/out/{write.last}")


def debounce(stream: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """Events of a user closer than the gap as one job: start, count and latest kind.

    Jobs leave the state once the watermark, `late` behind the newest event, has passed their
    end; a drained stream gives them all (mode complete).
    """
    jobs = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.max_by("event_type", F.struct("ts", "event_type")).alias("last_kind"))
    return jobs.select("user_id", F.col("w.start").alias("start"), "events", "last_kind")


def windowed(stream: DataFrame, size: str, slide: str, late: str) -> DataFrame:
    """Counts and sums per kind in sliding windows; events later than `late` are dropped by a long-running stream."""
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "events", "value")
