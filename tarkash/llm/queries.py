"""The queries of this package's operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarkash.llm import bpe, languages, mixing, neighbours, pages, pairs, persons, scans, similar
from tarkash.sources import read_table


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = read_table(spark, sf_dir, "parsed").select("doc_key", F.col("subject").alias("title"))
    return pages.header_lines(read_table(spark, sf_dir, "blocks"), titles)


def p5_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, columns, parsed = (read_table(spark, sf_dir, t) for t in ("blocks", "table_columns", "parsed"))
    return languages.label_languages(blocks, columns, parsed, _headers(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.wrong_labels(p5_labels(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read_table(spark, sf_dir, "documents"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_defects(read_table(spark, sf_dir, "blocks"), read_table(spark, sf_dir, "page_routes"), _headers(spark, sf_dir))


def p1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.paragraphs(read_table(spark, sf_dir, "blocks"), read_table(spark, sf_dir, "page_routes"), _headers(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defective_pairs(read_table(spark, sf_dir, "sub_questions"), "sub_question_id", "question_text", "answer_text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "sub_questions")
    return neighbours.mutual(neighbours.nearest(rows, "sub_question_id", "embedding", k=10, min_similarity=0.9))


def p3_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf_dir, "sub_questions"), "sub_question_id", "embedding", k=10)


PAIR_TEXTS = ["question_text", "answer_text"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar_pairs(read_table(spark, sf_dir, "sub_questions"), "sub_question_id", PAIR_TEXTS)


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar_groups(read_table(spark, sf_dir, "sub_questions"), "sub_question_id", PAIR_TEXTS)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(*(read_table(spark, sf_dir, t) for t in ("documents", "source_targets", "parsed")))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p7_mix(spark, sf_dir), read_table(spark, sf_dir, "source_targets"))


def p7_axis_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, targets, parsed = (read_table(spark, sf_dir, t) for t in ("documents", "source_targets", "parsed"))
    return mixing.axis_shares(documents, mixing.mix(documents, targets, parsed), targets, parsed)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    field = spark.sparkContext.broadcast(persons.fit(documents))
    return persons.mentions(documents, field).select("doc_id", "kind", "start_pos")


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    field = spark.sparkContext.broadcast(persons.fit(documents))
    return persons.redacted(documents, field)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
