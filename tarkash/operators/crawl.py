"""Source trees of questions: folders, the files of annexures, and spans of lines put right."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarkash.functions.replies import annexure_numbers
from tarkash.functions.text import label_number


def folders(files: DataFrame, path: str, passed: tuple[str, ...]) -> DataFrame:
    """One row a folder with files: `folder`, `kept` (its path without the categories in `passed`), `files`, `reply`, `depth`.

    Trees under a name that starts with a dot or an underscore are reserved and left out.
    `reply` says whether a file is named as one; `depth` is the place of the first part of
    the path that is a question (it holds a digit and does not start with a year), 0 for none.
    """
    parts = F.split(path, "/")
    rows = files.where(~F.exists(parts, lambda p: p.rlike(r"^[._]"))).select(F.slice(parts, 1, F.size(parts) - 1).alias("q"), F.lower(F.element_at(parts, -1)).alias("name"))
    out = rows.groupBy("q").agg(F.count("*").alias("files"), F.bool_or(F.col("name").rlike("reply|answer")).alias("reply"))
    kept = F.filter("q", lambda p: ~F.lower(p).isin(*passed))
    question = F.transform("q", lambda p: p.rlike("[0-9]") & ~p.rlike("^[0-9]{4}"))
    return out.select(F.array_join("q", "/").alias("folder"), F.array_join(kept, "/").alias("kept"), "files", "reply", F.array_position(question, True).cast("int").alias("depth"))


def resolve_annexures(refs: DataFrame, files: DataFrame, key: str, label: str, file: str) -> DataFrame:
    """The file of each named annexure: `file`, `confidence`.

    A file whose name has the annexure's number is it, a PDF before others, then by name; one
    that fits alone is sure (`high`), of several the choice is `low`. Where none has the
    number, the only annexure file without one is taken (`low`). `none` without a file.
    """
    wanted = refs.select(key, label, label_number(F.substring_index(label, "-", -1)).alias("_n"))
    held = files.select(key, F.col(file).alias("_file"), F.explode(annexure_numbers(F.col(file))).alias("_m"))
    best = F.min_by("_file", F.struct((~F.lower("_file").endswith(".pdf")).alias("a"), "_file"))
    numbered = held.where("_m > 0").groupBy(key, "_m").agg(best.alias("_file"), F.count_distinct("_file").alias("_many"))
    bare = held.where("_m = 0").groupBy(key).agg(F.min("_file").alias("_bare"), F.count_distinct("_file").alias("_bares")).where("_bares = 1").drop("_bares")
    out = wanted.join(numbered, (wanted[key] == numbered[key]) & (wanted["_n"] == numbered["_m"]), "left").select(wanted[key], label, "_file", "_many").join(bare, key, "left")
    return out.select(key, label, F.coalesce("_file", "_bare").alias(file), F.when(F.col("_many") == 1, "high").when(F.col("_file").isNotNull() | F.col("_bare").isNotNull(), "low").otherwise("none").alias("confidence"))


def repair_spans(spans: DataFrame, key: list[str], least: str, most: str, tie: str) -> DataFrame:
    """Spans (`first`, `last`) moved into their range, turned the right way round, and ended before the next one begins; none gets shorter than a line."""
    low, high = F.least("first", "last"), F.greatest("first", "last")
    rows = spans.withColumn("_f", F.greatest(F.col(least), low)).withColumn("_t", F.least(F.col(most), high)).drop("first", "last")
    after = F.lead("_f").over(Window.partitionBy(*key).orderBy("_f", "_t", tie)) - 1
    return rows.withColumn("last", F.greatest(F.col("_f"), F.least(F.col("_t"), F.coalesce(after, F.col("_t")))).cast("int")).withColumn("first", F.col("_f").cast("int")).drop("_f", "_t")
