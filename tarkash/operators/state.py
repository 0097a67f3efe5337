"""State over plain tables: upserts, deletes, queues and logs as DataFrames in, DataFrames out.

Nothing is changed in place. A new state is written beside the old one and the pointer is
swapped (`Snapshots`), so a lost task or a repeated run leaves a whole state behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Rows of both, of each key the one of the greatest version; `new` wins ties."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce(F.col(version).cast("timestamp"), F.timestamp_seconds(F.lit(0))), "_new")).alias("_row"))
    return last.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest if c != "_new"])


def insert_absent(old: DataFrame, new: DataFrame, key: list[str], order: Column) -> DataFrame:
    """`old` and the rows of `new` whose key is not there yet; of several the first by `order`."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")
    return old.unionByName(first.join(old.select(*key).distinct(), key, "left_anti"))


def soft_delete(rows: DataFrame, gone: DataFrame, key: list[str], reason: str, at: Column) -> DataFrame:
    """`rows` with `active`, `deleted_at` and `deleted_reason` set for the keys in `gone`."""
    marked = rows.join(gone.select(*key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    hit = F.coalesce("_gone", F.lit(False))
    return marked.select(*rows.columns, (~hit).alias("active"), F.when(hit, at).alias("deleted_at"), F.when(hit, F.lit(reason)).alias("deleted_reason"))


def cascade(parents: DataFrame, children: dict[str, tuple[DataFrame, str, str]]) -> dict[str, DataFrame]:
    """Children left once `parents` are deleted, and their own children in turn.

    children: name to (rows, column of the parent's key, own key), parents before children.
    """
    gone, out = parents, {}
    for name, (rows, parent, own) in children.items():
        dead = gone.select(F.col(gone.columns[0]).alias(parent)).distinct()
        out[name] = rows.join(dead, parent, "left_anti")
        gone = rows.join(dead, parent, "left_semi").select(own)
    return out


def retry(rows: DataFrame, failed: Column, attempts: str, at: Column, step: int = 30, most: int = 5) -> DataFrame:
    """`next_attempts`, `next_status`, `due_at` after a run: a failure waits `step` seconds times its attempts, and is `failed` at `most`."""
    n = F.col(attempts) + F.when(failed, 1).otherwise(0)
    state = F.when(~failed, "done").when(n >= most, "failed").otherwise("pending")
    due = F.when(failed & (n < most), at + F.make_dt_interval(secs=(n * step).cast("decimal(18,6)")))
    return rows.select("*", n.alias("next_attempts"), state.alias("next_status"), due.alias("due_at"))


def sessions(events: DataFrame, key: str, at: str, kind: str, gap_seconds: int) -> DataFrame:
    """Events of a key closer than the gap, coalesced: `start`, `deadline`, `events`, `last_kind`.

    Events exactly one gap apart belong together.
    """
    grouped = events.groupBy(key, F.session_window(at, f"{gap_seconds} seconds").alias("w")).agg(F.count("*").alias("events"), F.max_by(kind, F.struct(at, kind)).alias("last_kind"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("deadline"), "events", "last_kind")


def patch(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """`old` with the given columns overwritten where `new` has a value for them; keys that are only in `new` are added with NULL elsewhere."""
    fresh = new.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = old.join(fresh, key, "full")
    return joined.select(*key, *[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns if c not in key])


def recover_stale(jobs: DataFrame, claimed_at: str, now: Column, seconds: int, attempts: str, most: int = 5) -> DataFrame:
    """`recovered_status` of claimed jobs: those claimed longer than `seconds` ago go back to `pending`, or are `failed` after `most` attempts; others stay `claimed`."""
    stale = F.unix_timestamp(now) - F.unix_timestamp(claimed_at) > seconds
    return jobs.withColumn("recovered_status", F.when(~stale, "claimed").when(F.col(attempts) >= most, "failed").otherwise("pending"))


def resolve_deletes(deletes: DataFrame, listing: DataFrame, key: list[str]) -> DataFrame:
    """What a delete means when it is due: `upsert` where the path is there again, else `delete`."""
    return deletes.join(listing.select(*key).distinct().withColumn("_there", F.lit(True)), key, "left").withColumn("action", F.when(F.col("_there"), "upsert").otherwise("delete")).drop("_there")


def split_moves(events: DataFrame, kind: str, source: str, target: str) -> DataFrame:
    """`path`, `action` of file events: a move is a delete and an upsert, folders (a path that ends in a slash) are ignored."""
    one = lambda p, a: F.struct(p.alias("path"), F.lit(a).alias("action"))
    made = F.when(F.col(kind) == "moved", F.array(one(F.col(source), "delete"), one(F.col(target), "upsert"))).when(F.col(kind) == "deleted", F.array(one(F.col(source), "delete"))).otherwise(F.array(one(F.col(source), "upsert")))
    return events.withColumn("_m", F.explode(made)).select(*[c for c in events.columns if c not in (kind, source, target)], "_m.path", "_m.action").where(~F.col("path").endswith("/"))


def reactivate(rows: DataFrame, back: DataFrame, key: list[str], at: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, log): soft-deleted rows whose key is in `back` are active again, and a log row says so for each."""
    marked = rows.join(back.select(*key).distinct().withColumn("_back", F.lit(True)), key, "left")
    hit = F.coalesce(F.col("_back") & ~F.col("active"), F.lit(False))
    out = marked.select(*key, *[c for c in rows.columns if c not in (*key, "active", "deleted_at", "deleted_reason")], (F.col("active") | hit).alias("active"), *[F.when(~hit, F.col(c)).alias(c) for c in ("deleted_at", "deleted_reason")])
    return out, marked.where(hit).select(*key, F.lit("reactivate").alias("action"), at.alias("at"))


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of parents in `new` give way to those in `new`; the others stay."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def invalidated(rows: DataFrame, new: DataFrame, key: str, text: str, vector: str) -> DataFrame:
    """`rows` whose text differs in `new` with that text and without their vector, to be made again."""
    fresh = new.select(key, F.col(text).alias("_text"), F.lit(True).alias("_there"))
    changed = F.coalesce(F.col("_there") & ~F.col("_text").eqNullSafe(F.col(text)), F.lit(False))
    return rows.join(fresh, key, "left").select(*[F.when(changed, F.col("_text")).otherwise(F.col(text)).alias(text) if c == text else F.when(~changed, F.col(vector)).alias(vector) if c == vector else F.col(c) for c in rows.columns])


def keep_names(new: DataFrame, known: DataFrame, content: str, name: str) -> DataFrame:
    """`new` with the name under which the same content was recorded first, where it was."""
    first = known.groupBy(content).agg(F.min(name).alias("_name"))
    return new.join(first, content, "left").select(*[F.coalesce("_name", name).alias(name) if c == name else F.col(c) for c in new.columns])


def trace_steps(rows: DataFrame, run: str, at: str) -> DataFrame:
    """Events of runs as trace rows: `step` from 1 and `seconds` to the next step (NULL for the last), for an append to a log."""
    w = Window.partitionBy(run).orderBy(at, *[c for c in rows.columns if c not in (run, at)])
    return rows.withColumn("step", F.row_number().over(w)).withColumn("seconds", F.unix_timestamp(F.lead(at).over(w)) - F.unix_timestamp(at))


def append_log(rows: DataFrame, folder: str) -> bool:
    """Appends rows to a log as JSON lines; a log that cannot be written stops nothing and gives False."""
    try:
        rows.write.mode("append").json(folder)
    except Exception:  # a log never breaks the work that it tells of
        return False
    return True


class Snapshots:
    """A table kept as numbered Parquet snapshots with a pointer to the current one.

    The folder may be on any file system that Spark reads; the pointer is a file whose name
    holds the number, so that a snapshot is current once that name is there.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int | None:
        found = self._fs.globStatus(self._path(f"{self.folder}/CURRENT-*")) or []
        return max((int(f.getPath().getName().rsplit("-", 1)[1]) for f in found), default=None)

    def read(self) -> DataFrame | None:
        """The current state, None before the first write."""
        v = self.version()
        return None if v is None else self.spark.read.parquet(f"{self.folder}/v{v}")

    def write(self, rows: DataFrame) -> int:
        """Writes the next snapshot, then makes it current by creating its pointer."""
        v = (self.version() or 0) + 1
        rows.write.mode("overwrite").parquet(f"{self.folder}/v{v}")
        self._fs.create(self._path(f"{self.folder}/CURRENT-{v}"), False).close()
        return v
