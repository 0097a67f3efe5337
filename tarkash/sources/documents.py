"""Nested documents: their schema, reading and writing them, and the flat tables in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE = "struct<table_id:string,caption:string,table_role:string,answer_is_table:boolean,columns:array<struct<name:string,role:string,language:string>>,rows:array<struct<row_id:string,cells:map<string,string>,row_language:string,nl_rendering:string,entities:array<string>>>,stitched_across_pages:boolean,extraction_confidence:string>"
SCHEMA = (
    "question_id string, session string, house string, state string, starred boolean, subject string, reply_date string, reply_format string, document_language string,"
    " diary_numbers array<string>, extraction_flags array<string>, annexures_referenced array<string>, tables_index array<string>,"
    " sub_questions array<struct<sub_question_id:string,part_label:string,question_text:string,question_language:string,answer_group_id:string,annexure_refs:array<string>>>,"
    f" answer_groups array<struct<answer_group_id:string,answers_parts:array<string>,answer_text:string,answer_type:string,answer_language:string,answer_is_table:boolean,answer_blocks:array<struct<heading:string,text:string>>,tables:array<{TABLE}>,annexure_refs:array<string>,confidence:string>>,"
    f" annexures array<struct<ref_label:string,referenced_in_parts:array<string>,file_path:string,file_present:boolean,match_confidence:string>>, diary_level_tables array<{TABLE}>,"
    " file_metadata struct<relative_path:string,original_filename:string,extension:string,size_bytes:bigint,last_modified:string,sha256:string,page_count:int>"
)


def read_documents(spark: SparkSession, path: str, only: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, bad): documents read with the fixed schema, one a file, and what could not be read."""
    raw = spark.read.schema(SCHEMA + ", _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumn("source_path", F.col("_metadata.file_path"))
    if only:
        raw = raw.where(F.col("source_path").contains(only))
    good = raw.where("_corrupt_record IS NULL AND question_id IS NOT NULL").drop("_corrupt_record")
    return good.withColumn("doc_key", F.concat_ws("/", "session", "house", "question_id")), raw.where("_corrupt_record IS NOT NULL OR question_id IS NULL").select("source_path", "_corrupt_record")


def tree(spark: SparkSession, root: str) -> DataFrame:
    """Files under a folder: `path`, `modified`, `bytes`, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def flatten(docs: DataFrame) -> dict[str, DataFrame]:
    """The flat tables of nested documents; child ids come under their document's key.

    A sub-question whose group is missing gets a placeholder group, marked `orphan`.
    """
    key = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("#", "doc_key", c))
    diaries = docs.drop("sub_questions", "answer_groups", "annexures", "diary_level_tables")
    subs = docs.select("doc_key", F.inline("sub_questions")).select("doc_key", key("sub_question_id").alias("sub_question_id"), "part_label", "question_text", "question_language", key("answer_group_id").alias("answer_group_id"), "annexure_refs")
    groups = docs.select("doc_key", F.inline("answer_groups")).withColumn("answer_group_id", key("answer_group_id"))
    flat = groups.drop("tables").withColumn("orphan", F.lit(False))
    dangling = subs.where("answer_group_id IS NOT NULL").select("doc_key", "answer_group_id").distinct().join(flat.select("answer_group_id"), "answer_group_id", "left_anti").withColumn("orphan", F.lit(True))
    tables = groups.select("doc_key", "answer_group_id", F.inline("tables")).withColumn("table_id", key("table_id"))
    rows = tables.select("doc_key", "table_id", F.posexplode("rows").alias("n", "r")).select("doc_key", "table_id", (F.col("n") + 1).alias("row_index"), "r.*")
    own = docs.select("doc_key", F.inline("diary_level_tables")).withColumn("table_id", key("table_id"))
    return {
        "diaries": diaries, "sub_questions": subs, "answer_groups": flat.unionByName(dangling, allowMissingColumns=True), "answer_tables": tables.drop("rows"), "answer_table_rows": rows,
        "diary_level_tables": own.drop("rows"), "diary_level_table_rows": own.select("doc_key", "table_id", F.posexplode("rows").alias("n", "r")).select("doc_key", "table_id", (F.col("n") + 1).alias("row_index"), "r.*"), "annexures": docs.select("doc_key", F.inline("annexures")),
    }


def from_lines(rows: DataFrame, column: str) -> DataFrame:
    """Documents from JSON text, one a row, with their `doc_key`; text that is no document is left out."""
    docs = rows.select(F.from_json(column, SCHEMA).alias("d")).where("d.question_id IS NOT NULL").select("d.*")
    return docs.withColumn("doc_key", F.concat_ws("/", "session", "house", "question_id"))


def nest(docs: DataFrame, subs: DataFrame, groups: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """Documents with their sub-questions and answer groups (and `more` fields of these) as arrays, in order of their ids.

    For output only: a stored document is one row, however many parts it has.
    """
    s = subs.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct(F.col("sub_question_local").alias("sub_question_id"), "part_label", "question_text", "question_language", F.substring_index("answer_group_id", "#", -1).alias("answer_group_id"), "annexure_refs"))).alias("sub_questions"))
    g = groups.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct(F.col("answer_group_local").alias("answer_group_id"), "answers_parts", "answer_type", "answer_language", "answer_is_table", "confidence", *[c.alias(n) for n, c in (more or {}).items()]))).alias("answer_groups"))
    return docs.join(s, "doc_key", "left").join(g, "doc_key", "left")


def write_report(rows: DataFrame, folder: str) -> None:
    """A report as JSON lines and as CSV with a header; lists are joined by semicolons in the CSV."""
    rows.write.mode("overwrite").json(f"{folder}/json")
    flat = [F.array_join(c, ";").alias(c) if t.startswith("array<string>") else F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
