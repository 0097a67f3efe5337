"""Retrieval queries over sub-questions, answers and documents, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarkash.functions import models
from tarkash.operators import retrieval as R
from tarkash.sources import read_table
from tarkash.sources.tables import checkpoint

TERMS = ["tunnel", "compensation", "water", "villages"]
ENTITIES = ["tunnel", "project", "dam", "villages", "district", "reservoir", "station"]
SQL: dict[str, str] = {}

SUBS = "(SELECT DISTINCT sub_question_id, doc_key, answer_group_id, question_text, answer_text, embedding FROM sub_questions)"
DOCS = "(SELECT DISTINCT doc_key, session, house, subject, starred, reply_date, document_language FROM parsed)"
SEED = f"(SELECT embedding AS q FROM {SUBS} WHERE embedding IS NOT NULL AND sub_question_id = (SELECT min(sub_question_id) FROM sub_questions WHERE embedding IS NOT NULL) LIMIT 1)"
COS = "round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6)"


def _subs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "sub_questions").dropDuplicates(["sub_question_id"])


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "parsed").dropDuplicates(["doc_key"])


def _seed(spark: SparkSession, sf_dir: str) -> list[float]:
    rows = read_table(spark, sf_dir, "sub_questions").where("embedding IS NOT NULL").select("sub_question_id", "embedding")
    return rows.agg(F.min_by("embedding", "sub_question_id")).first()[0]  # one vector, the query


def dense_topk(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings")
    query = rows.where("vec_id = 0").select("embedding").first()[0]
    return R.dense_topk(rows, "vec_id", "embedding", query, 20).select("vec_id", "label", "score", "rank")


SQL["dense_topk"] = """SELECT vec_id, label, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], s.embedding::DOUBLE[]), 6) AS score
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) s) ORDER BY score DESC, vec_id LIMIT 20"""


def dense_topk_filtered(spark, sf_dir):
    docs = _docs(spark, sf_dir).where("house = 'lok_sabha' AND starred").select("doc_key", "session")
    rows = _subs(spark, sf_dir).select("sub_question_id", "doc_key", "embedding").join(docs, "doc_key")
    return R.dense_topk(rows, "sub_question_id", "embedding", _seed(spark, sf_dir), 30).select("sub_question_id", "doc_key", "session", "score", "rank")


SQL["dense_topk_filtered"] = f"""SELECT sub_question_id, doc_key, session, score, row_number() OVER (ORDER BY score DESC, sub_question_id) AS rank FROM (
  SELECT s.sub_question_id, s.doc_key, d.session, {COS} AS score FROM {SUBS} s JOIN {DOCS} d USING (doc_key), {SEED}
  WHERE d.house = 'lok_sabha' AND d.starred IS TRUE AND embedding IS NOT NULL) ORDER BY score DESC, sub_question_id LIMIT 30"""


def dense_expand(spark, sf_dir):
    subs = _subs(spark, sf_dir)
    top = R.dense_topk(subs.select("sub_question_id", "answer_group_id", "embedding"), "sub_question_id", "embedding", _seed(spark, sf_dir), 30)
    groups = top.groupBy("answer_group_id").agg(F.max("score").alias("score"))
    return F.broadcast(groups).join(subs.select("answer_group_id", "sub_question_id", "doc_key"), "answer_group_id").select("sub_question_id", "doc_key", "answer_group_id", "score")


SQL["dense_expand"] = f"""WITH top AS (SELECT answer_group_id, score FROM (SELECT sub_question_id, answer_group_id, {COS} AS score FROM {SUBS}, {SEED} WHERE embedding IS NOT NULL) ORDER BY score DESC, sub_question_id LIMIT 30)
SELECT s.sub_question_id, s.doc_key, s.answer_group_id, g.score FROM (SELECT answer_group_id, max(score) AS score FROM top GROUP BY 1) g JOIN {SUBS} s USING (answer_group_id)"""


def lexical_topk(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return R.lexical_topk(rows, "doc_id", "text", TERMS, 30).select("doc_id", "source", "score", "rank")


def _bm25(rel: str, key: str, more: str, k: int) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(TERMS))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(TERMS)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * l / a))" for i in range(len(TERMS)))
    hits = " + ".join(f"tf{i}" for i in range(len(TERMS)))
    return f"""(WITH w AS (SELECT {key}, {more}, regexp_extract_all(lower(text), '[a-z]+') AS w FROM {rel} WHERE text IS NOT NULL),
  c AS (SELECT {key}, {more}, len(w) AS l, {tf} FROM w), s AS (SELECT count(*) AS n, avg(l) AS a, {df} FROM c)
  SELECT {key}, {more}, score, row_number() OVER (ORDER BY score DESC, {key}) AS rank FROM (SELECT {key}, {more}, round({score}, 6) AS score FROM c, s WHERE {hits} > 0) ORDER BY score DESC, {key} LIMIT {k})"""


SQL["lexical_topk"] = "SELECT * FROM " + _bm25("documents", "doc_id", "source", 30)


def _links(subs: DataFrame) -> DataFrame:
    words = F.array_intersect(R.terms_of(F.col("question_text")), F.lit(ENTITIES))  # only words of the query leave the scan
    return subs.select(F.col("sub_question_id").alias("item"), "doc_key", F.explode(words).alias("entity"))


LINKS = f"(SELECT DISTINCT sub_question_id AS item, doc_key, unnest(regexp_extract_all(lower(question_text), '[a-z]+')) AS entity FROM {SUBS})"
IN_ENTITIES = "entity IN (" + ", ".join(f"'{e}'" for e in ENTITIES) + ")"


def lexical_index(spark, sf_dir):
    """The same list by way of an inverted index, which a corpus keeps for all its queries."""
    index = R.postings(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return R.search(index, TERMS, 30).select(F.col("key").alias("doc_id"), "score", "rank")


SQL["lexical_index"] = "SELECT doc_id, score, rank FROM " + _bm25("documents", "doc_id", "source", 30)


def dense_answer_topk(spark, sf_dir):
    """Answers nearest to the answer of the first sub-question, by the vectors of their letters, with all sub-questions that share them: by distance, then id.

    Answers without letters have no vector. The list is cut to 30 answers before it is expanded.
    """
    subs = read_table(spark, sf_dir, "sub_questions").select("sub_question_id", "doc_key", "answer_group_id", "answer_text").dropDuplicates(["sub_question_id"])
    answers = subs.groupBy("answer_group_id").agg(F.min_by("answer_text", "sub_question_id").alias("answer_text"))
    vectors = checkpoint(answers.select("answer_group_id", models.letter_vector(F.col("answer_text")).alias("vector")).where("vector IS NOT NULL"))
    query = vectors.agg(F.min_by("vector", "answer_group_id")).first()[0]  # one vector
    if query is None:
        return subs.limit(0).select("sub_question_id", "doc_key", "answer_group_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    top = R.dense_topk(vectors, "answer_group_id", "vector", query, 30).select("answer_group_id", "score")
    shown = subs.join(F.broadcast(top), "answer_group_id").select("sub_question_id", "doc_key", "answer_group_id", "score")
    return shown.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "sub_question_id")))  # what 30 answers expand to


LETTERS = "list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: (length(answer_text) - length(replace(lower(answer_text), c, '')))::DOUBLE)"
SQL["dense_answer_topk"] = f"""WITH a AS (SELECT answer_group_id, arg_min(answer_text, sub_question_id) AS answer_text FROM (SELECT DISTINCT sub_question_id, answer_group_id, answer_text FROM sub_questions) GROUP BY 1),
v AS (SELECT answer_group_id, {LETTERS} AS v FROM a WHERE regexp_matches(lower(answer_text), '[a-z]')), q AS (SELECT arg_min(v, answer_group_id) AS q FROM v),
t AS (SELECT answer_group_id, round(list_cosine_similarity(v, q), 6) AS score FROM v, q ORDER BY 2 DESC, 1 LIMIT 30)
SELECT s.sub_question_id, s.doc_key, s.answer_group_id, score, row_number() OVER (ORDER BY score DESC, s.sub_question_id) AS rank FROM (SELECT DISTINCT sub_question_id, doc_key, answer_group_id FROM sub_questions) s JOIN t USING (answer_group_id)"""


def entity_hits(spark, sf_dir):
    return R.entity_topk(_links(_subs(spark, sf_dir)), ENTITIES, 30).select("item", "doc_key", "score", "rank")


ENTITY_LIST = f"(SELECT item, doc_key, score, row_number() OVER (ORDER BY score DESC, item) AS rank FROM (SELECT item, doc_key, count(DISTINCT entity) AS score FROM {LINKS} WHERE {IN_ENTITIES} GROUP BY 1, 2) ORDER BY score DESC, item LIMIT 30)"
SQL["entity_hits"] = f"SELECT * FROM {ENTITY_LIST}"
DENSE_LIST = f"(SELECT sub_question_id AS item, doc_key, row_number() OVER (ORDER BY score DESC, sub_question_id) AS rank FROM (SELECT sub_question_id, doc_key, {COS} AS score FROM {SUBS}, {SEED} WHERE embedding IS NOT NULL) ORDER BY score DESC, sub_question_id LIMIT 50)"
KEYWORD_LIST = "(SELECT sub_question_id AS item, doc_key, rank FROM " + _bm25(f"(SELECT sub_question_id, doc_key, question_text AS text FROM {SUBS})", "sub_question_id", "doc_key", 30) + ")"


def _lists(spark, sf_dir) -> dict[str, DataFrame]:
    """Ranked lists of a query, each bounded and written once, as several steps read them. Reloads are dropped after scoring, when rows are narrow."""
    rows = read_table(spark, sf_dir, "sub_questions")
    item = F.col("sub_question_id").alias("item")
    subs = rows.select("sub_question_id", "doc_key", "question_text").dropDuplicates(["sub_question_id"])
    vectors = rows.select("sub_question_id", "doc_key", "embedding").where("embedding IS NOT NULL")
    lists = {
        "dense": R.dense_topk(vectors, "sub_question_id", "embedding", _seed(spark, sf_dir), 50, distinct=True).select(item, "doc_key", "rank"),
        "entity": R.entity_topk(_links(subs), ENTITIES, 30).select("item", "doc_key", "rank"),
        "keyword": R.lexical_topk(subs.select("sub_question_id", "doc_key", "question_text"), "sub_question_id", "question_text", TERMS, 30).select(item, "doc_key", "rank"),
    }
    whole = reduce(DataFrame.unionByName, [d.select(F.lit(name).alias("list"), "item", "doc_key", "rank") for name, d in lists.items()])
    whole = checkpoint(whole)  # at most k rows a list
    return {name: whole.where(F.col("list") == name).drop("list") for name in lists}


HITS = f"""hits AS (SELECT 'dense' AS retriever, 0 AS place, 1.0::DOUBLE / (60 + rank) AS add, * FROM {DENSE_LIST}
  UNION ALL SELECT 'entity', 1, 0.5::DOUBLE / (60 + rank), item, doc_key, rank FROM {ENTITY_LIST}
  UNION ALL SELECT 'keyword', 2, 0.7::DOUBLE / (60 + rank), item, doc_key, rank FROM {KEYWORD_LIST}),
fused AS (SELECT doc_key, round(sum(add), 6) AS rrf_score, arg_max(item, (add, -place, -rank)) AS item,
  min(rank) FILTER (retriever = 'dense') AS dense_rank, min(rank) FILTER (retriever = 'entity') AS entity_rank, min(rank) FILTER (retriever = 'keyword') AS keyword_rank,
  count(DISTINCT retriever) AS found_by, round(count(DISTINCT retriever) / greatest(1, (SELECT count(DISTINCT retriever) FROM hits)), 3) AS agreement FROM hits GROUP BY doc_key)"""


def rrf_fuse(spark, sf_dir):
    """The flagship: three ranked lists fused by document, in order of display."""
    fused = R.ranked(R.fuse(_lists(spark, sf_dir)), 50, F.desc("rrf_score"), F.asc("doc_key"))
    shown = fused.join(_docs(spark, sf_dir).select("doc_key", "subject", "reply_date"), "doc_key", "left")
    return R.display_order(shown, "reply_date", "rank").select("doc_key", "item", "subject", "reply_date", "rrf_score", "dense_rank", "entity_rank", "keyword_rank", "found_by", "agreement", "rank", "display_rank")


SQL["rrf_fuse"] = f"""WITH {HITS}, top AS (SELECT *, row_number() OVER (ORDER BY rrf_score DESC, doc_key) AS rank FROM fused ORDER BY rrf_score DESC, doc_key LIMIT 50)
SELECT t.doc_key, t.item, d.subject, d.reply_date, rrf_score, dense_rank, entity_rank, keyword_rank, found_by, agreement, rank, row_number() OVER (ORDER BY d.reply_date DESC NULLS LAST, rank) AS display_rank FROM top t LEFT JOIN {DOCS} d USING (doc_key)"""


def rrf_best_rank(spark, sf_dir):
    return R.fuse(_lists(spark, sf_dir), mode="best_rank").select("doc_key", "rrf_score", "agreement")


SQL["rrf_best_rank"] = f"""WITH {HITS}, best AS (SELECT retriever, doc_key, max(add) AS add FROM hits GROUP BY 1, 2)
SELECT doc_key, round(sum(add), 6) AS rrf_score, round(count(*) / greatest(1, (SELECT count(DISTINCT retriever) FROM hits)), 3) AS agreement FROM best GROUP BY doc_key"""


def rrf_stats_widen(spark, sf_dir):
    return R.fusion_stats(R.fuse(_lists(spark, sf_dir)))


SQL["rrf_stats_widen"] = f"""WITH {HITS}, o AS (SELECT rrf_score, row_number() OVER (ORDER BY rrf_score DESC, doc_key) AS n FROM fused),
s AS (SELECT count(*) AS n_candidates, coalesce(max(rrf_score), 0) AS top_score, round(coalesce(max(rrf_score), 0) - coalesce(max(rrf_score) FILTER (n = 2), 0), 6) AS score_gap FROM o)
SELECT *, n_candidates = 0 OR top_score < 0.015 OR score_gap < 0.0015 AS widen FROM s"""


def rrf_calibration(spark, sf_dir):
    lists = _lists(spark, sf_dir)
    out = None
    for name, rows in lists.items():
        one = rows.select(F.lit(name).alias("retriever"), (F.lit(R.WEIGHTS[name]) / (60 + F.col("rank"))).alias("add"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("retriever").agg(F.count("*").alias("hits"), F.round(F.min("add"), 6).alias("least"), F.round(F.max("add"), 6).alias("most"))


SQL["rrf_calibration"] = f"WITH {HITS} SELECT retriever, count(*) AS hits, round(min(add), 6) AS least, round(max(add), 6) AS most FROM hits GROUP BY 1"


def rank_movement(spark, sf_dir):
    top = R.ranked(R.fuse(_lists(spark, sf_dir)), 80, F.desc("rrf_score"), F.asc("doc_key")).select("doc_key", "item", "rrf_score")
    subs = _subs(spark, sf_dir).select(F.col("sub_question_id").alias("item"), "question_text")
    words = R.terms_of(F.col("question_text"))
    overlap = F.try_divide(F.size(F.array_intersect(words, F.lit(TERMS + ENTITIES))), F.size(F.array_distinct(words)))
    scored = subs.join(F.broadcast(top), "item").withColumn("rerank", F.round(F.coalesce(overlap, F.lit(0.0)), 6))
    return R.with_movement(scored, "rrf_score", "rerank", "doc_key").select("doc_key", "rerank", "old_rank", "new_rank", "moved")


ALL_TERMS = "[" + ", ".join(f"'{t}'" for t in TERMS + ENTITIES) + "]"
SQL["rank_movement"] = f"""WITH {HITS}, top AS (SELECT * FROM fused ORDER BY rrf_score DESC, doc_key LIMIT 80),
s AS (SELECT t.doc_key, rrf_score, round(coalesce(len(list_intersect(list_distinct(w), {ALL_TERMS})) / nullif(len(list_distinct(w)), 0), 0), 6) AS rerank FROM top t JOIN (SELECT sub_question_id AS item, regexp_extract_all(lower(question_text), '[a-z]+') AS w FROM {SUBS}) q USING (item)),
r AS (SELECT *, row_number() OVER (ORDER BY rrf_score DESC, doc_key) AS old_rank, row_number() OVER (ORDER BY rerank DESC, doc_key) AS new_rank FROM s)
SELECT doc_key, rerank, old_rank, new_rank, old_rank - new_rank AS moved FROM r"""


def _logits(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 17 != 0, F.col("value") / 10 - 3).alias("logit"))


LOGITS = "(SELECT event_id, user_id, CASE WHEN event_id % 17 <> 0 THEN value / 10 - 3 END AS logit FROM events)"
SIGMOID = "round(1 / (1 + exp(-logit)), 6)"


def sigmoid_filter(spark, sf_dir):
    return R.relevance_filter(_logits(spark, sf_dir), "logit", 0.02, 50, "event_id").select("event_id", "relevance")


SQL["sigmoid_filter"] = f"SELECT event_id, relevance FROM (SELECT event_id, logit, {SIGMOID} AS relevance FROM {LOGITS}) WHERE logit IS NULL OR relevance >= 0.02 ORDER BY relevance DESC NULLS LAST, event_id LIMIT 50"


def plateau_guard(spark, sf_dir):
    rows = _logits(spark, sf_dir).withColumn("relevance", F.round(1 / (1 + F.exp(-F.col("logit"))), 6))
    return R.plateau(rows, ["user_id"], "relevance", 12, 0.6)


SQL["plateau_guard"] = f"""WITH r AS (SELECT user_id, {SIGMOID} AS relevance, row_number() OVER (PARTITION BY user_id ORDER BY {SIGMOID} DESC NULLS LAST) AS n FROM {LOGITS})
SELECT user_id, count(*) AS candidates, count(*) FILTER (relevance > 0.9) AS wide, max(relevance) FILTER (n = 12) AS nth_best, coalesce(max(relevance) FILTER (n = 12) >= 0.6 AND count(*) FILTER (relevance > 0.9) >= 12, false) AS plateau FROM r GROUP BY user_id"""


def answer_pattern(spark, sf_dir):
    groups = read_table(spark, sf_dir, "answer_groups").dropDuplicates(["answer_group_id"])
    counts = groups.groupBy("doc_key", "answer_type").agg(F.count("*").alias("n"))
    total = counts.groupBy("doc_key").agg(F.sum("n").alias("total"), F.max_by(F.struct("answer_type", "n"), F.struct("n", "answer_type")).alias("top"))
    return total.where(F.col("top.n") >= F.greatest(F.lit(2.0), F.col("total") * 0.5)).select("doc_key", F.col("top.answer_type").alias("pattern"), F.col("top.n").alias("n"), "total")


SQL["answer_pattern"] = """WITH c AS (SELECT doc_key, answer_type, count(*) AS n FROM (SELECT DISTINCT answer_group_id, doc_key, answer_type FROM answer_groups) GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY doc_key)::BIGINT AS total, row_number() OVER (PARTITION BY doc_key ORDER BY n DESC, answer_type DESC NULLS LAST) AS k FROM c)
SELECT doc_key, answer_type AS pattern, n, total FROM r WHERE k = 1 AND n >= greatest(2, total * 0.5)"""


def assemble_payload(spark, sf_dir):
    groups = read_table(spark, sf_dir, "answer_groups").dropDuplicates(["answer_group_id"]).select("answer_group_id", "answer_type", F.size("answers_parts").alias("parts"))
    docs = _docs(spark, sf_dir).select("doc_key", "subject", "reply_date", F.array_join(F.array_sort("annexures_referenced"), ";").alias("annexures"))
    subs = _subs(spark, sf_dir).select("sub_question_id", "doc_key", "answer_group_id", "part_label")
    return subs.join(docs, "doc_key").join(groups, "answer_group_id").select("sub_question_id", "doc_key", "part_label", "subject", "reply_date", "annexures", "answer_type", "parts")


SQL["assemble_payload"] = f"""SELECT s.sub_question_id, s.doc_key, s.part_label, d.subject, d.reply_date, d.annexures, g.answer_type, g.parts FROM (SELECT DISTINCT sub_question_id, doc_key, answer_group_id, part_label FROM sub_questions) s
JOIN (SELECT DISTINCT doc_key, subject, reply_date, array_to_string(list_sort(annexures_referenced), ';') AS annexures FROM parsed) d USING (doc_key)
JOIN (SELECT DISTINCT answer_group_id, answer_type, len(answers_parts) AS parts FROM answer_groups) g USING (answer_group_id)"""


def display_order(spark, sf_dir):
    top = R.ranked(R.fuse(_lists(spark, sf_dir)), 40, F.desc("rrf_score"), F.asc("doc_key")).select("doc_key", "rank")
    dated = F.broadcast(top).join(_docs(spark, sf_dir).select("doc_key", "reply_date"), "doc_key")
    return R.display_order(dated, "reply_date", "rank").select("doc_key", "reply_date", "rank", "display_rank")


SQL["display_order"] = f"""WITH {HITS}, top AS (SELECT doc_key, row_number() OVER (ORDER BY rrf_score DESC, doc_key) AS rank FROM fused ORDER BY rrf_score DESC, doc_key LIMIT 40)
SELECT doc_key, d.reply_date, rank, row_number() OVER (ORDER BY d.reply_date DESC NULLS LAST, rank) AS display_rank FROM top JOIN {DOCS} d USING (doc_key)"""


def verdict_cache(spark, sf_dir):
    """Verdicts looked up by the hash of the normalised query and the item: here every answered question is cached."""
    subs = _subs(spark, sf_dir)
    ask = F.sha2(F.lower(F.trim("question_text")), 256)
    cache = subs.where("answer_text IS NOT NULL").select(ask.alias("query_hash"), "sub_question_id", (F.length("answer_text") > 200).alias("similar"))
    return subs.select(ask.alias("query_hash"), "sub_question_id").join(cache, ["query_hash", "sub_question_id"], "left").select("sub_question_id", "query_hash", F.coalesce("similar", F.lit(True)).alias("verdict"), F.col("similar").isNotNull().alias("cached"))


SQL["verdict_cache"] = f"SELECT sub_question_id, sha256(lower(trim(question_text))) AS query_hash, coalesce(length(answer_text) > 200, true) AS verdict, answer_text IS NOT NULL AS cached FROM {SUBS}"


def verify_batches(spark, sf_dir):
    """Candidates of a document numbered in batches of twelve, positions from 0."""
    n = F.row_number().over(Window.partitionBy("doc_key").orderBy("sub_question_id")) - 1
    return _subs(spark, sf_dir).select("doc_key", "sub_question_id", F.floor(n / 12).alias("batch"), (n % 12).alias("position"))


SQL["verify_batches"] = f"SELECT doc_key, sub_question_id, n // 12 AS batch, n % 12 AS position FROM (SELECT doc_key, sub_question_id, row_number() OVER (PARTITION BY doc_key ORDER BY sub_question_id) - 1 AS n FROM {SUBS})"


def queries():
    return {name: globals()[name] for name in SQL}


def oracle_sql():
    return SQL
