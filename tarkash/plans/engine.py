"""A question answered from end to end: lists, fusion, one widening, reranking, filter, payload."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarkash.functions import models
from tarkash.functions import text as T
from tarkash.operators import dictionary, retrieval
from tarkash.sources import read_table
from tarkash.sources.tables import checkpoint

QUESTION = "Please provide the details of all villages affected by the tunnel project and the compensation paid"
SYNONYMS = {"paid": "disbursed", "hydro power": "hydroelectric"}


@dataclass(frozen=True)
class Options:
    dense: int = 50
    keyword: int = 30
    entity: int = 30
    pool: int = 80
    most: int = 50
    threshold: float = 0.02
    house: str | None = None
    session: str | None = None
    widen: int = 3


def canonical(spark: SparkSession, question: str, names: DataFrame) -> tuple[str, list[str]]:
    """The question without wrappers and with synonyms, and the entities that it or its canonical form names."""
    one = spark.createDataFrame([(0, question)], "k int, t string")
    plain = one.select(T.strip_filler(T.apply_synonyms(F.lower("t"), SYNONYMS)).alias("t")).first().t
    both = spark.createDataFrame([(0, question), (1, plain)], "k int, t string")
    found = dictionary.match(both, "k", "t", names).select("entity_id").distinct().orderBy("entity_id").limit(50).collect()
    return plain, [r.entity_id for r in found]


def _lists(subs: DataFrame, vectors: DataFrame, linked: DataFrame, plain: str, entities: list[str], o: Options) -> dict[str, DataFrame]:
    rows = subs
    if o.house:
        rows = rows.where(F.col("house") == o.house)
    if o.session:
        rows = rows.where(F.col("session") == o.session)
    item = F.col("sub_question_id").alias("item")
    keys = rows.select("sub_question_id", "doc_key")
    query = models.embed_text(plain) or [0.0] * models.DIMENSIONS
    lists = {
        "dense": retrieval.dense_topk(vectors.join(keys, "sub_question_id"), "sub_question_id", "vector", query, o.dense).select(item, "doc_key", "rank"),
        "keyword": retrieval.lexical_topk(rows.select("sub_question_id", "doc_key", "question_text"), "sub_question_id", "question_text", sorted({w for w in plain.split() if w.isascii() and w.isalpha() and len(w) > 3}), o.keyword).select(item, "doc_key", "rank"),
    }
    if entities:  # without entities the list is not eligible
        lists["entity"] = retrieval.entity_topk(linked.join(keys, "sub_question_id").select(item, "doc_key", F.col("entity_id").alias("entity")), entities, o.entity).select("item", "doc_key", "rank")
    return lists


def answer(spark: SparkSession, sf_dir: str, question: str = QUESTION, options: Options = Options()) -> DataFrame:  # noqa: B008
    """Documents that answer a question, in order of display; at most `options.most`.

    A weak fused list is widened once: `widen` times as many hits a list, no filters. A
    blank question has no answers.
    """
    docs = read_table(spark, sf_dir, "parsed").dropDuplicates(["doc_key"]).select("doc_key", "session", "house", "subject", "reply_date")
    subs = read_table(spark, sf_dir, "sub_questions").select("sub_question_id", "doc_key", "question_text", "answer_group_id").dropDuplicates(["sub_question_id"]).join(docs, "doc_key")
    names = dictionary.build(docs.select("doc_key", F.regexp_extract("subject", r"(?:in|at|below|near|to|of) ([A-Z][a-z]+(?:[ -][A-Z][A-Za-z]*)*)", 1).alias("name")), "name", "place", F.col("doc_key"))
    plain, entities = canonical(spark, question, names)
    vectors = checkpoint(models.embed(subs, "sub_question_id", "question_text"))  # made once, for both tries; a corpus keeps them
    linked = dictionary.match(subs, "sub_question_id", "question_text", names) if entities else subs.select("sub_question_id", F.lit("").alias("entity_id"))
    fused = checkpoint(retrieval.fuse(_lists(subs, vectors, linked, plain, entities, options)))  # read by the test for widening and after
    if retrieval.fusion_stats(fused).first().widen:
        o = replace(options, dense=options.dense * options.widen, keyword=options.keyword * options.widen, entity=options.entity * options.widen, house=None, session=None)
        fused = checkpoint(retrieval.fuse(_lists(subs, vectors, linked, plain, entities, o)))
    pool = retrieval.ranked(fused.select("doc_key", "item", "rrf_score", "agreement"), options.pool, F.desc("rrf_score"), F.asc("doc_key")).withColumnRenamed("rank", "fused_rank")
    texts = subs.select(F.col("sub_question_id").alias("item"), "question_text", "answer_group_id")
    scored = texts.join(F.broadcast(pool), "item").withColumn("logit", models.overlap_logit(plain, F.col("question_text")))  # at most `pool` rows
    kept = retrieval.relevance_filter(scored, "logit", options.threshold, options.most, "doc_key").where(models.judge_similar(F.col("logit"), -4.9))
    groups = read_table(spark, sf_dir, "answer_groups").dropDuplicates(["answer_group_id"]).select("answer_group_id", "answer_type")
    shown = kept.join(docs.select("doc_key", "subject", "reply_date"), "doc_key").join(groups, "answer_group_id", "left")
    return retrieval.display_order(shown, "reply_date", "fused_rank").select("doc_key", "item", "subject", "reply_date", "answer_type", "rrf_score", "agreement", "relevance", "fused_rank", "display_rank")


def engine_answers(spark, sf_dir):
    return answer(spark, sf_dir)


def queries():
    return {"engine_answers": engine_answers}


def oracle_sql():
    return {}
