"""Choosing among files of a question: reply candidates, the latest version, folders that are one question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarkash.functions.text import collapse, file_score, is_noise

PREFIX = r"(?i)^(?:assurance[\s.-]*)?(?:lsq|rsq|asq|usq|aq|sq|dy\.?|ls|rs|us|u)[\s.-]*"


def question_id(folder: Column) -> Column:
    """The bare question id of a folder name: revisions, a trailing date and house prefixes taken off, in lower case; `s-` marks starred ones."""
    s = F.regexp_replace(collapse(folder), r"(?i)\(?\s*revised[^)]*\)?", "")
    s = F.trim(F.regexp_replace(s, r"[\s,]*\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}\s*$", ""))
    starred = s.rlike(r"(?i)^(?:lsq|rsq|asq|sq)?[\s.-]*s[\s.-]*\d")
    digits = F.regexp_extract(F.regexp_replace(s, PREFIX, ""), r"(\d+(?:\s*[-&]\s*\d+)?)", 1)
    out = F.regexp_replace(digits, r"\s", "")
    return F.when(out == "", F.lower(s)).when(starred, F.concat(F.lit("s-"), out)).otherwise(out)


def house_of_folder(folder: Column) -> Column:
    """The house that a prefixed folder name implies; NULL without a prefix."""
    s = collapse(folder)
    return F.when(s.rlike(r"(?i)^(assurance\s*[-–:]?\s*)?(ls\s*q|usq)"), "lok_sabha").when(s.rlike(r"(?i)^(assurance\s*[-–:]?\s*)?rs\s*q"), "rajya_sabha").when(s.rlike(r"(?i)^(as\s*q|a\s*q\b)"), "vidhan_sabha")


def latest(files: DataFrame, key: list[str], name: str, modified: str) -> DataFrame:
    """One file of each key: best name, then latest, then PDF; `ties` counts others equal in name and time. Noise never wins."""
    low = F.lower(name)
    rows = files.where(~is_noise(F.col(name))).withColumn("score", file_score(F.col(name))).withColumn("pdf", low.endswith(".pdf"))
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct("score", F.coalesce(modified, F.timestamp_seconds(F.lit(0))), "pdf", name)).alias("f"))
    same = rows.groupBy(*key, "score", modified).agg(F.count("*").alias("n"))
    out = best.select(*key, "f.*").alias("a").join(same.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key] + [F.col("a.score") == F.col("b.score"), F.col(f"a.{modified}").eqNullSafe(F.col(f"b.{modified}"))])
    return out.select("a.*", (F.col("b.n") - 1).alias("ties"))


def merge_folders(folders: DataFrame, key: list[str], flags: str) -> DataFrame:
    """Folders of one question as one: how many, their flags, and whether one needs review."""
    return folders.groupBy(*key).agg(F.count("*").alias("folders"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(flags)))).alias("flags")).withColumn("review", (F.col("folders") > 1) | (F.size("flags") > 0))


def unclaimed(files: DataFrame, claimed: DataFrame, folder: str) -> DataFrame:
    """Files whose folder is no question's."""
    return files.join(claimed.select(folder).distinct(), folder, "left_anti")


def ranked_pages(pages: DataFrame, key: str) -> DataFrame:
    """Pages numbered in order within their document."""
    return pages.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy("page")))
