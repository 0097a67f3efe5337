"""Session and table access."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "tarkash", cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the library expects (UTC, AQE, Arrow)."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the test data layout, `<sf_dir>/<name>.parquet`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def newest_per_key(df: DataFrame, keys: list[str], order: str = "loaded_at") -> DataFrame:
    """One row per key: the one loaded last (NULL load times first, ties by content).

    Reloads repeat a key with the same content, so `max_by` on the load time merges
    them on the map side; no window and no sort of whole rows is needed.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    at = F.coalesce(F.col(order).cast("timestamp"), F.timestamp_seconds(F.lit(0)))
    picked = df.groupBy(*keys).agg(F.max_by(row, at).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def _loaded(order: str):
    return F.coalesce(F.col(order).cast("timestamp"), F.timestamp_seconds(F.lit(0)))


def newest_times(df: DataFrame, key: str, order: str = "loaded_at") -> DataFrame:
    """Each key with the time `_at` at which it was loaded last; only two columns are read."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(_loaded(order)).alias("_at"))


def newest_rows(df: DataFrame, key: str, columns: list[str], facts: DataFrame, order: str = "loaded_at") -> DataFrame:
    """Rows of `df` loaded last, joined with `facts` (the key, `_at` and more).

    For wide columns: rows are shuffled once and not sorted, as the narrow side is hashed.
    Rows that tie in key and time all come out.
    """
    wide = df.select(key, _loaded(order).alias("_mine"), *columns)
    return wide.join(facts.hint("shuffle_hash"), key).where("_mine = _at").drop("_mine", "_at")


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df`, which reads files only, over all cores by a key of many values, where its files are few.

    For work in Python on few or unsplittable files: with at least half as many files as
    cores, or with files that Spark splits into as many parts, the rows stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if 2 * len(df.inputFiles()) <= cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data: `spark.checkpoint.dir`, or the one set on the context.

    Only a local session may go without; it gets a temporary folder of this machine.
    """
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if told:
        return told
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder, its lineage cut; for narrow rows."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder as Parquet and read again; for wide rows, of which each reader takes its columns."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
