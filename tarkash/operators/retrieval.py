"""Ranked retrieval: vector, lexical and entity lists, their fusion, and what follows it.

Lists are bounded by k before they are ranked, so the global windows here see k rows of a
list and no more; scoring itself is a scan with a partial top-k per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarkash.functions.text import sigmoid
from tarkash.sources.tables import checkpoint

WEIGHTS = {"dense": 1.0, "keyword": 0.7, "entity": 0.5, "dense_answer": 0.7}
ORDER = ("dense", "entity", "keyword", "dense_answer")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; NULL where either is NULL or of length zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def ranked(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows by `order`, with `rank` from 1. The limit comes before the window."""
    return rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def dense_topk(rows: DataFrame, key: str, vector: str, query: list[float], k: int, distinct: bool = False) -> DataFrame:
    """The k rows of greatest cosine with the query vector; rows without a vector are left out, ties go to the smaller key.

    With `distinct` a repeated key counts once; it is dropped when the vectors are gone.
    """
    q = F.lit([float(x) for x in query])
    scored = rows.where(F.col(vector).isNotNull()).withColumn("score", F.round(cosine(F.col(vector), q), 6)).drop(vector).where("score IS NOT NULL")
    scored = scored.dropDuplicates([key]) if distinct else scored
    return ranked(scored, k, F.desc("score"), F.asc(key))


def terms_of(text: Column) -> Column:
    """Lower-case Latin words of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)


def _count(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def postings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """An inverted index, made once for all queries: `term`, `key`, `tf`, `length` (words of the row), for `search`.

    Rows without words have one posting of the empty term, so that the index also holds how
    many rows there are. Write it partitioned or sorted by term, and a query reads its terms.
    """
    words = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), terms_of(F.col(text)).alias("w"))
    listed = words.select("key", F.size("w").alias("length"), F.explode(F.concat(F.array(F.lit("")), F.col("w"))).alias("term"))
    return listed.groupBy("term", "key", "length").agg(F.count("*").cast("int").alias("tf")).select("term", "key", "tf", "length")


def search(index: DataFrame, terms: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """`key`, `score`, `rank`: the k rows of greatest BM25 for the terms, from an index of `postings`; only the terms' postings are read."""
    corpus = index.where("term = ''").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    hit = index.where(F.col("term").isin(*terms) if terms else F.lit(False))
    spread = hit.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = spread.crossJoin(F.broadcast(corpus)).select("term", idf.alias("idf"), "mean")  # a row a term
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = hit.join(F.broadcast(weights), "term").groupBy("key").agg(F.round(F.sum(part), 6).alias("score"))
    return ranked(scored, k, F.desc("score"), F.asc("key"))


def lexical_topk(rows: DataFrame, key: str, text: str, terms: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k rows of greatest BM25 for the query terms; rows with none of them are left out.

    For a single query, without an index: counts of the query terms are columns of the scan,
    kept for the rows that have any, and the corpus statistics one row; no word is shuffled.
    """
    if not terms:
        return ranked(rows.limit(0).withColumn("score", F.lit(0.0)), k, F.asc(key))
    words = rows.where(F.col(text).isNotNull()).withColumn("_w", terms_of(F.col(text)))
    counted = words.select(*[c for c in rows.columns if c != text], F.size("_w").alias("_len"), *[_count(F.col("_w"), t).alias(f"_tf{i}") for i, t in enumerate(terms)])
    counted = checkpoint(counted)  # a few numbers a row; read for the statistics and for the scores
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])
    joined = counted.crossJoin(F.broadcast(stats))  # one row
    parts = []
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        tf = F.col(f"_tf{i}")
        parts.append(idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_len") / F.col("_avg"))))
    hits = reduce(lambda x, y: x + y, [F.col(f"_tf{i}") for i in range(len(terms))])
    scored = joined.where(hits > 0).withColumn("score", F.round(reduce(lambda x, y: x + y, parts), 6)).select(*[c for c in rows.columns if c != text], "score")
    return ranked(scored, k, F.desc("score"), F.asc(key))


def entity_topk(links: DataFrame, entities: list[str], k: int) -> DataFrame:
    """The k items with the most different entities of the query; `links`: item, doc_key, entity. No entities, no rows."""
    found = links.where(F.col("entity").isin(*entities) if entities else F.lit(False)).groupBy("item", "doc_key").agg(F.countDistinct("entity").alias("score"))
    return ranked(found, k, F.desc("score"), F.asc("item"))


def fuse(lists: dict[str, DataFrame], k: int = 60, weights: dict[str, float] | None = None, mode: str = "sum") -> DataFrame:
    """Weighted reciprocal rank fusion by document.

    Every hit adds weight / (k + rank), so several hits of a document in one list add up;
    with mode `best_rank` only the best of each list does. Each document shows the item of
    its greatest single contribution (ties: order of the lists, then rank), the best rank
    in each list, and the share of the lists with hits that found it.
    """
    weights = weights or WEIGHTS
    hits = reduce(DataFrame.unionByName, [d.select(F.lit(name).alias("retriever"), F.lit(ORDER.index(name)).alias("place"), F.lit(weights[name]).alias("weight"), "doc_key", "item", "rank") for name, d in lists.items()])
    if mode == "best_rank":
        hits = hits.groupBy("retriever", "place", "weight", "doc_key").agg(F.min_by("item", "rank").alias("item"), F.min("rank").alias("rank"))
    hits = hits.withColumn("add", F.col("weight") / (k + F.col("rank")))
    best = F.struct("add", (-F.col("place")).alias("p"), (-F.col("rank")).alias("r"))
    fused = hits.groupBy("doc_key").agg(
        F.round(F.sum("add"), 6).alias("rrf_score"),
        F.max_by("item", best).alias("item"),
        *[F.min(F.when(F.col("retriever") == name, F.col("rank"))).alias(f"{name}_rank") for name in lists],
        F.countDistinct("retriever").alias("found_by"),
    )
    whole = Window.partitionBy(F.lit(1))  # at most k rows a list
    fired = reduce(lambda x, y: x + y, [F.max(F.col(f"{name}_rank").isNotNull().cast("int")).over(whole) for name in lists])
    return fused.withColumn("agreement", F.round(F.col("found_by") / F.greatest(F.lit(1), fired), 3))


def fusion_stats(fused: DataFrame, tau: float = 0.015, delta: float = 0.0015) -> DataFrame:
    """One row: `n_candidates`, `top_score`, `score_gap`, `widen` (whether the fused list is weak)."""
    top = fused.orderBy(F.desc("rrf_score")).limit(2).agg(F.max("rrf_score").alias("a"), F.min("rrf_score").alias("b"), F.count("*").alias("m"))
    n = fused.agg(F.count("*").alias("n_candidates"))
    gap = F.coalesce(F.round(F.when(F.col("m") > 1, F.col("a") - F.col("b")).otherwise(F.col("a")), 6), F.lit(0.0))
    rows = n.crossJoin(F.broadcast(top)).select("n_candidates", F.coalesce("a", F.lit(0.0)).alias("top_score"), gap.alias("score_gap"))
    return rows.withColumn("widen", (F.col("n_candidates") == 0) | (F.col("top_score") < tau) | (F.col("score_gap") < delta))


def with_movement(rows: DataFrame, before: str, after: str, key: str) -> DataFrame:
    """Ranks by two scores of a bounded list and how far each row moved up."""
    by = lambda c: F.row_number().over(Window.orderBy(F.desc(c), F.asc(key)))
    return rows.withColumn("old_rank", by(before)).withColumn("new_rank", by(after)).withColumn("moved", F.col("old_rank") - F.col("new_rank"))


def relevance_filter(rows: DataFrame, logit: str, threshold: float, most: int, key: str) -> DataFrame:
    """Rows whose sigmoid reaches the threshold, and those without a logit (their relevance is NULL); at most `most`, best first."""
    rows = rows.withColumn("relevance", F.round(sigmoid(F.col(logit)), 6)).where(F.col(logit).isNull() | (F.col("relevance") >= threshold))
    return rows.orderBy(F.desc_nulls_last("relevance"), F.asc(key)).limit(most)


def plateau(rows: DataFrame, group: list[str], relevance: str, n: int = 12, threshold: float = 0.97) -> DataFrame:
    """Per group whether the n-th best relevance reaches the threshold and more than 0.9 is reached n times or more."""
    top = Window.partitionBy(*group).orderBy(F.desc_nulls_last(relevance))
    nth = rows.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= n)
    wide = rows.groupBy(*group).agg(F.count("*").alias("candidates"), F.count_if(F.col(relevance) > 0.9).alias("wide"))
    best = nth.groupBy(*group).agg(F.max(F.when(F.col("_r") == n, F.col(relevance))).alias("nth_best"))
    return wide.join(best, group).withColumn("plateau", F.coalesce((F.col("nth_best") >= threshold) & (F.col("wide") >= n), F.lit(False)))


def display_order(rows: DataFrame, date: str, relevance_rank: str) -> DataFrame:
    """`display_rank` of a bounded list: newest first, rows without a date last, then by relevance."""
    return rows.withColumn("display_rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(date), F.asc(relevance_rank))))
