"""Relational, window, set and state queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarkash.operators import state
from tarkash.sources import read_table

SQL: dict[str, str] = {}
AS_OF = "2024-01-20 00:00:00"
SUBS = "(SELECT DISTINCT sub_question_id, doc_key, answer_group_id, part_label, question_text, answer_text, confidence, embedding_model, len(embedding) AS dim FROM sub_questions)"
DOCS = "(SELECT DISTINCT doc_key, session, house, state, subject, starred, reply_date, reply_format, document_language, parser_used, ocr_used, page_count FROM parsed)"


def _subs(spark, sf_dir):
    return read_table(spark, sf_dir, "sub_questions").dropDuplicates(["sub_question_id"])


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "parsed").dropDuplicates(["doc_key"])


def corpus_overview(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("session", "house").agg(F.count("*").alias("documents"), F.count_if("ocr_used").alias("scanned"), F.count_if(F.col("state").isNotNull()).alias("with_state"))


SQL["corpus_overview"] = f"SELECT session, house, count(*) AS documents, count(*) FILTER (ocr_used) AS scanned, count(state) AS with_state FROM {DOCS} GROUP BY 1, 2"


def type_counts(spark, sf_dir):
    groups = read_table(spark, sf_dir, "answer_groups").dropDuplicates(["answer_group_id"])
    return groups.groupBy("answer_type").count().withColumnRenamed("count", "n")


SQL["type_counts"] = "SELECT answer_type, count(*) AS n FROM (SELECT DISTINCT answer_group_id, answer_type FROM answer_groups) GROUP BY 1"


def model_coverage(spark, sf_dir):
    rows = _subs(spark, sf_dir).select(F.when(F.col("embedding").isNull(), "(none)").otherwise(F.coalesce("embedding_model", F.lit("(unnamed)"))).alias("model"), F.size("embedding").alias("dim"))
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.min(F.when(F.col("dim") > 0, F.col("dim"))).alias("least_dim"))


SQL["model_coverage"] = f"SELECT CASE WHEN dim IS NULL THEN '(none)' ELSE coalesce(embedding_model, '(unnamed)') END AS model, count(*) AS n, min(dim) AS least_dim FROM {SUBS} GROUP BY 1"


def labels_per_document(spark, sf_dir):
    return _subs(spark, sf_dir).groupBy("doc_key").agg(F.array_join(F.array_sort(F.collect_list("part_label")), ",").alias("labels"), F.array_join(F.array_sort(F.collect_set(F.substring("confidence", 1, 1))), "").alias("confidences"))


SQL["labels_per_document"] = f"SELECT doc_key, coalesce(string_agg(part_label, ',' ORDER BY part_label), '') AS labels, coalesce(string_agg(DISTINCT left(confidence, 1), '' ORDER BY left(confidence, 1)), '') AS confidences FROM {SUBS} GROUP BY 1"


def children_counts(spark, sf_dir):
    """Sub-questions of every document, also of those without any."""
    subs = _subs(spark, sf_dir).groupBy("doc_key").agg(F.count("*").alias("n"))
    return _docs(spark, sf_dir).select("doc_key").join(subs, "doc_key", "left").select("doc_key", F.coalesce("n", F.lit(0)).alias("sub_questions"))


SQL["children_counts"] = f"SELECT d.doc_key, count(s.sub_question_id) AS sub_questions FROM {DOCS} d LEFT JOIN {SUBS} s USING (doc_key) GROUP BY 1"


def stale_rows(spark, sf_dir):
    rows = _subs(spark, sf_dir).where(~F.col("embedding_model").eqNullSafe("embed-mini-64") | F.col("embedding").isNull())
    return rows.where(F.coalesce(F.trim("answer_text"), F.lit("")) != "").select("sub_question_id", F.when(F.col("embedding").isNull(), "missing").otherwise("stale").alias("mode"))


SQL["stale_rows"] = f"SELECT sub_question_id, CASE WHEN dim IS NULL THEN 'missing' ELSE 'stale' END AS mode FROM {SUBS} WHERE (embedding_model IS DISTINCT FROM 'embed-mini-64' OR dim IS NULL) AND coalesce(trim(answer_text), '') <> ''"


def vocabulary(spark, sf_dir):
    refs = read_table(spark, sf_dir, "parsed").select(F.explode(F.concat("annexures_referenced", "diary_numbers", "extraction_flags")).alias("term"))
    return refs.where(F.length(F.trim("term")).between(3, 60) & ~F.col("term").rlike(r"^[0-9.,%/ -]*$") & ~F.lower("term").isin("nil", "total", "unit")).distinct()


SQL["vocabulary"] = "SELECT DISTINCT term FROM (SELECT unnest(annexures_referenced || diary_numbers || extraction_flags) AS term FROM parsed) WHERE length(trim(term)) BETWEEN 3 AND 60 AND NOT regexp_matches(term, '^[0-9.,%/ -]*$') AND lower(term) NOT IN ('nil', 'total', 'unit')"


def answer_vocabulary_hits(spark, sf_dir):
    """Annexures that a document names, joined to the sub-questions that refer to them."""
    docs = _docs(spark, sf_dir).select("doc_key", F.explode("annexures_referenced").alias("ref"))
    subs = _subs(spark, sf_dir).select("doc_key", "sub_question_id", F.explode("annexure_refs").alias("ref"))
    return docs.distinct().join(subs, ["doc_key", "ref"]).groupBy("doc_key", "ref").agg(F.countDistinct("sub_question_id").alias("n"))


SQL["answer_vocabulary_hits"] = "SELECT d.doc_key, d.ref, count(DISTINCT s.sub_question_id) AS n FROM (SELECT DISTINCT doc_key, unnest(annexures_referenced) AS ref FROM parsed) d JOIN (SELECT DISTINCT doc_key, sub_question_id, unnest(annexure_refs) AS ref FROM sub_questions) s ON d.doc_key = s.doc_key AND d.ref = s.ref GROUP BY 1, 2"


def feedback_export(spark, sf_dir):
    """Orders with their customer and nation and, where there is one, their first returned line."""
    orders, customer, nation = (read_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    returned = read_table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("line"), F.round(F.sum("l_extendedprice"), 2).alias("value"))
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", "c_name", "n_name", "line", "value")


SQL["feedback_export"] = "SELECT o_orderkey, c_name, n_name, line, value FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT l_orderkey, min(l_linenumber) AS line, round(sum(l_extendedprice), 2) AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON o_orderkey = l_orderkey"


def correlated_counts(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return read_table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


SQL["correlated_counts"] = "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders FROM customer"


def self_join_parent(spark, sf_dir):
    """Each document with the one before it of the same session and house, by diary number text."""
    docs = _docs(spark, sf_dir).select("doc_key", "session", "house")
    w = Window.partitionBy("session", "house").orderBy("doc_key")
    pairs = docs.withColumn("before", F.lag("doc_key").over(w))
    names = _docs(spark, sf_dir).select(F.col("doc_key").alias("before"), F.col("subject").alias("before_subject"))
    return pairs.join(names, "before", "left").select("doc_key", "before", "before_subject")


SQL["self_join_parent"] = f"WITH d AS (SELECT *, lag(doc_key) OVER (PARTITION BY session, house ORDER BY doc_key) AS before FROM {DOCS}) SELECT d.doc_key, d.before, p.subject AS before_subject FROM d LEFT JOIN {DOCS} p ON p.doc_key = d.before"


def anti_repoint(spark, sf_dir):
    """Orders that could move to the survivor of their customer's nation and segment unless it has one of that priority."""
    customer, orders = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "orders")
    first = customer.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("survivor"))  # a row a group
    kept = customer.join(first, ["c_nationkey", "c_mktsegment"]).select("c_custkey", "survivor")
    moves = orders.join(kept, orders.o_custkey == kept.c_custkey).where("c_custkey <> survivor").select("o_orderkey", "survivor", "o_orderpriority")
    owned = orders.select(F.col("o_custkey").alias("survivor"), "o_orderpriority").distinct()
    return moves.join(owned, ["survivor", "o_orderpriority"], "left_anti").select("o_orderkey", "survivor")


SQL["anti_repoint"] = "WITH k AS (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS survivor FROM customer) SELECT o_orderkey, survivor FROM orders o JOIN k ON o_custkey = c_custkey WHERE c_custkey <> survivor AND NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = survivor AND x.o_orderpriority = o.o_orderpriority)"


def semi_children(spark, sf_dir):
    big = read_table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").alias("l_orderkey"))
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(big, "l_orderkey", "left_semi")


SQL["semi_children"] = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)"


def paged_history(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    total = orders.agg(F.count("*").alias("total"))
    return orders.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20).crossJoin(F.broadcast(total))


SQL["paged_history"] = "SELECT o_orderkey, o_orderdate, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40"


def latest_version(spark, sf_dir):
    """The latest order of each customer by priority, then date; `ties` counts equals."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", F.desc(F.to_date("o_orderdate")))
    rows = read_table(spark, sf_dir, "orders").withColumn("place", F.rank().over(w)).where("place = 1")
    return rows.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"), F.count("*").alias("ties"))


SQL["latest_version"] = "SELECT o_custkey, min(o_orderkey) AS o_orderkey, count(*) AS ties FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate::DATE DESC) AS place FROM orders) WHERE place = 1 GROUP BY 1"


def upsert_latest(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    old, new = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")
    return state.upsert(old, new, ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id", "value")


SQL["upsert_latest"] = "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id % 2 DESC) AS n FROM events) WHERE n = 1"


def first_claim_wins(spark, sf_dir):
    parts = read_table(spark, sf_dir, "part").select(F.lower("p_type").alias("alias"), "p_partkey")
    old = parts.where("p_partkey <= 20").groupBy("alias").agg(F.min("p_partkey").alias("p_partkey"))
    return state.insert_absent(old, parts.where("p_partkey > 20"), ["alias"], F.asc("p_partkey"))


SQL["first_claim_wins"] = "SELECT lower(p_type) AS alias, min(p_partkey) AS p_partkey FROM part GROUP BY 1"


def cascade_delete(spark, sf_dir):
    customer = read_table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")
    orders, lines = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    left = state.cascade(customer, {"orders": (orders, "o_custkey", "o_orderkey"), "lines": (lines, "l_orderkey", "l_linenumber")})
    return left["lines"].groupBy("l_orderkey").agg(F.count("*").alias("lines"))


SQL["cascade_delete"] = "SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) GROUP BY 1"


def soft_delete_log(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_key", "session")
    gone = _docs(spark, sf_dir).where("page_count = 1")
    rows = state.soft_delete(docs, gone, ["doc_key"], "source_removed", F.lit(AS_OF).cast("timestamp"))
    return rows.groupBy("session", "active", "deleted_reason").agg(F.count("*").alias("n"))


SQL["soft_delete_log"] = f"SELECT session, page_count IS DISTINCT FROM 1 AS active, CASE WHEN page_count = 1 THEN 'source_removed' END AS deleted_reason, count(*) AS n FROM {DOCS} GROUP BY 1, 2, 3"


def null_backfill(spark, sf_dir):
    """The next known subject in reading order for documents that lack one."""
    w = Window.partitionBy("session", "house").orderBy(F.desc("doc_key")).rowsBetween(Window.unboundedPreceding, -1)  # a running frame, worked out once
    docs = _docs(spark, sf_dir).select("doc_key", "session", "house", "subject")
    return docs.select("doc_key", F.coalesce("subject", F.last("subject", ignorenulls=True).over(w)).alias("subject"))


SQL["null_backfill"] = f"SELECT doc_key, coalesce(subject, first_value(subject IGNORE NULLS) OVER (PARTITION BY session, house ORDER BY doc_key ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS subject FROM {DOCS}"
BLOCKS = "(SELECT DISTINCT block_id, doc_key, page, seq, kind, text FROM blocks)"


def _blocks(spark, sf_dir):
    return read_table(spark, sf_dir, "blocks").dropDuplicates(["block_id"])


def heading_spans(spark, sf_dir):
    """Where the text under each heading ends: before the next heading of the document."""
    w = Window.partitionBy("doc_key").orderBy("seq")
    heads = _blocks(spark, sf_dir).where("kind = 'heading'").select("doc_key", "seq")
    return heads.select("doc_key", "seq", (F.lead("seq").over(w) - 1).alias("last_seq"), F.coalesce(F.lag("seq").over(w) == F.col("seq") - 1, F.lit(False)).alias("adjacent"))


SQL["heading_spans"] = f"SELECT doc_key, seq, lead(seq) OVER w - 1 AS last_seq, coalesce(lag(seq) OVER w = seq - 1, false) AS adjacent FROM {BLOCKS} WHERE kind = 'heading' WINDOW w AS (PARTITION BY doc_key ORDER BY seq)"


def stitch_rows(spark, sf_dir):
    """Blocks joined to the list item that they continue: a new group starts at each item or heading."""
    w = Window.partitionBy("doc_key", "page").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.when(F.col("kind") != "text", 1).otherwise(0)
    rows = _blocks(spark, sf_dir).withColumn("island", F.sum(starts).over(w))
    return rows.groupBy("doc_key", "page", "island").agg(F.count("*").alias("blocks"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


SQL["stitch_rows"] = f"SELECT doc_key, page, island::BIGINT AS island, count(*) AS blocks, sum(length(coalesce(text, '')))::BIGINT AS chars FROM (SELECT *, sum(CASE WHEN kind <> 'text' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_key, page ORDER BY seq) AS island FROM {BLOCKS}) GROUP BY 1, 2, 3"


def jaccard_groups(spark, sf_dir):
    """Mean Jaccard similarity of the flags of documents that share a reply date, and whether all are equal."""
    docs = _docs(spark, sf_dir).where("reply_date IS NOT NULL").select("reply_date", F.array_sort(F.array_distinct("extraction_flags")).alias("f"))
    sets = docs.groupBy("reply_date", "f").agg(F.count("*").alias("n"))  # equal sets once; pairs of different ones are weighted by their counts
    a, b = sets.alias("a"), sets.alias("b")
    different = a.join(b, (F.col("a.reply_date") == F.col("b.reply_date")) & (F.col("a.f") < F.col("b.f")))
    both, either = F.size(F.array_intersect("a.f", "b.f")), F.size(F.array_union("a.f", "b.f"))
    apart = different.select(F.col("a.reply_date").alias("reply_date"), (both / F.greatest(either, F.lit(1))).alias("j"), (F.col("a.n") * F.col("b.n")).alias("w"))
    equal = sets.where("n > 1").select("reply_date", F.lit(1.0).alias("j"), (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("w"))
    return apart.unionByName(equal).groupBy("reply_date").agg(F.round(F.sum(F.col("j") * F.col("w")) / F.sum("w"), 6).alias("mean_jaccard"), F.bool_and(F.col("j") == 1).alias("same"))


SQL["jaccard_groups"] = "WITH d AS (SELECT DISTINCT doc_key, reply_date, list_sort(list_distinct(extraction_flags)) AS f FROM parsed WHERE reply_date IS NOT NULL), p AS (SELECT a.reply_date, CASE WHEN len(list_distinct(a.f || b.f)) = 0 THEN 1.0 ELSE len(list_intersect(a.f, b.f))::DOUBLE / len(list_distinct(a.f || b.f)) END AS j FROM d a JOIN d b ON a.reply_date = b.reply_date AND a.doc_key < b.doc_key) SELECT reply_date, round(avg(j), 6) AS mean_jaccard, bool_and(j = 1) AS same FROM p GROUP BY 1"


def value_percentiles(spark, sf_dir):
    """Exact percentiles of each kind: values are counted, and the two around each percentile found in the running count of slices of the values."""
    counts = read_table(spark, sf_dir, "events").where("value IS NOT NULL").groupBy("event_type", "value").agg(F.count("*").alias("c"))
    edges = counts.select("event_type", "value", "c", F.floor(F.col("value") * 4).alias("slice"))
    slices = edges.groupBy("event_type", "slice").agg(F.sum("c").alias("in_slice"))
    before = slices.withColumn("before", F.sum("in_slice").over(Window.partitionBy("event_type").orderBy("slice")) - F.col("in_slice")).withColumn("n", F.sum("in_slice").over(Window.partitionBy("event_type")))  # a row a slice
    upto = F.sum("c").over(Window.partitionBy("event_type", "slice").orderBy("value")) + F.col("before")
    ranked = edges.join(before.drop("in_slice"), ["event_type", "slice"]).select("event_type", "value", "n", (upto - F.col("c")).alias("lo"), upto.alias("hi"))
    parts = []
    for name, p in (("p50", 0.5), ("p95", 0.95)):
        at = (F.col("n") - 1) * p
        holds = lambda r: F.max(F.when((F.col("lo") <= r) & (r < F.col("hi")), F.col("value")))
        low, high = holds(F.floor(at)), holds(F.ceil(at))
        parts.append(F.round(low + (high - low) * F.max(at - F.floor(at)), 6).alias(name))
    counted = read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counted.join(ranked.groupBy("event_type").agg(*parts), "event_type", "left").select("event_type", "n", "p50", "p95")


SQL["value_percentiles"] = "SELECT event_type, count(*) AS n, round(median(value), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1"


def zero_rates(spark, sf_dir):
    counts = children_counts(spark, sf_dir).join(_docs(spark, sf_dir).select("doc_key", "house"), "doc_key")
    return counts.groupBy("house").agg(F.round(F.avg((F.col("sub_questions") == 0).cast("double")), 6).alias("zero_rate"), F.round(F.avg((F.col("sub_questions") > 2).cast("double")), 6).alias("hit_rate"))


SQL["zero_rates"] = f"SELECT house, round(avg((n = 0)::INT), 6) AS zero_rate, round(avg((n > 2)::INT), 6) AS hit_rate FROM (SELECT d.doc_key, d.house, count(s.sub_question_id) AS n FROM {DOCS} d LEFT JOIN {SUBS} s USING (doc_key) GROUP BY 1, 2) GROUP BY 1"


def set_diff_classes(spark, sf_dir):
    """New, dropped and common parts of two years of shipments, by brand."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_partkey", F.year("l_shipdate").alias("y"))
    before = lines.where("y = 1995").select("l_partkey").distinct().withColumn("b", F.lit(1))
    after = lines.where("y = 1996").select("l_partkey").distinct().withColumn("a", F.lit(1))
    both = before.join(after, "l_partkey", "full").join(read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return both.groupBy("p_brand").agg(F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("a").isNull()).alias("dropped"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("kept"))


SQL["set_diff_classes"] = "WITH b AS (SELECT DISTINCT l_partkey, 1 AS b FROM lineitem WHERE year(l_shipdate) = 1995), a AS (SELECT DISTINCT l_partkey, 1 AS a FROM lineitem WHERE year(l_shipdate) = 1996) SELECT p_brand, count(*) FILTER (b IS NULL) AS added, count(*) FILTER (a IS NULL) AS dropped, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS kept FROM b FULL JOIN a USING (l_partkey) JOIN part ON p_partkey = l_partkey GROUP BY 1"


def set_operations(spark, sf_dir):
    """Nations of customers and suppliers: in both, and only in one."""
    c = read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s = read_table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    parts = [c.intersect(s).withColumn("kind", F.lit("both")), c.exceptAll(s).distinct().join(s.distinct(), "k", "left_anti").withColumn("kind", F.lit("customers")), s.subtract(c).withColumn("kind", F.lit("suppliers"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SQL["set_operations"] = "WITH c AS (SELECT c_nationkey AS k FROM customer), s AS (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) (SELECT k, 'both' AS kind FROM (SELECT k FROM c INTERSECT SELECT k FROM s)) UNION ALL (SELECT k, 'customers' FROM (SELECT k FROM c EXCEPT SELECT k FROM s)) UNION ALL (SELECT k, 'suppliers' FROM (SELECT k FROM s EXCEPT SELECT k FROM c))"


def provenance_union(spark, sf_dir):
    """Where each annexure of a document is named: in questions, in the document, or both."""
    q = _subs(spark, sf_dir).select("doc_key", F.explode("annexure_refs").alias("ref"), F.lit("question").alias("src"))
    d = _docs(spark, sf_dir).select("doc_key", F.explode("annexures_referenced").alias("ref"), F.lit("document").alias("src"))
    return q.unionByName(d).groupBy("doc_key", "ref").agg(F.collect_set("src").alias("s")).select("doc_key", "ref", F.when(F.size("s") > 1, "both").otherwise(F.get("s", F.lit(0))).alias("provenance"))


SQL["provenance_union"] = "SELECT doc_key, ref, CASE WHEN count(DISTINCT src) > 1 THEN 'both' ELSE min(src) END AS provenance FROM (SELECT doc_key, unnest(annexure_refs) AS ref, 'question' AS src FROM sub_questions UNION ALL SELECT doc_key, unnest(annexures_referenced), 'document' FROM parsed) GROUP BY 1, 2"


def parse_counters(spark, sf_dir):
    """Counts of documents by parser, by format, and of all, in one pass."""
    rows = _docs(spark, sf_dir).select(F.coalesce("parser_used", F.lit("?")).alias("parser_used"), F.coalesce("reply_format", F.lit("?")).alias("reply_format"))
    return rows.groupingSets([["parser_used"], ["reply_format"], []], "parser_used", "reply_format").agg(F.count("*").alias("n"))


SQL["parse_counters"] = f"SELECT parser_used, reply_format, count(*) AS n FROM (SELECT coalesce(parser_used, '?') AS parser_used, coalesce(reply_format, '?') AS reply_format FROM {DOCS}) GROUP BY GROUPING SETS ((parser_used), (reply_format), ())"


def flag_counters(spark, sf_dir):
    return read_table(spark, sf_dir, "parsed").dropDuplicates(["doc_key"]).select("house", F.explode("extraction_flags").alias("flag")).groupBy("flag").pivot("house", ["lok_sabha", "rajya_sabha", "vidhan_sabha"]).agg(F.count(F.lit(1))).na.fill(0)


SQL["flag_counters"] = "SELECT flag, count(*) FILTER (house = 'lok_sabha') AS lok_sabha, count(*) FILTER (house = 'rajya_sabha') AS rajya_sabha, count(*) FILTER (house = 'vidhan_sabha') AS vidhan_sabha FROM (SELECT doc_key, house, unnest(extraction_flags) AS flag FROM (SELECT DISTINCT doc_key, house, extraction_flags FROM parsed)) GROUP BY 1"


def document_audit(spark, sf_dir):
    """Per document: sub-questions without an answer, answer groups that none refers to, and links to no group."""
    subs = _subs(spark, sf_dir).select("doc_key", "answer_group_id", "answer_text")
    groups = read_table(spark, sf_dir, "answer_groups").dropDuplicates(["answer_group_id"]).select("answer_group_id", F.col("doc_key").alias("g_doc"))
    joined = subs.join(groups, "answer_group_id", "full")
    key = F.coalesce("doc_key", "g_doc").alias("doc_key")
    return joined.groupBy(key).agg(F.count_if(F.col("doc_key").isNotNull() & (F.coalesce(F.trim("answer_text"), F.lit("")) == "")).alias("empty"), F.count_if(F.col("doc_key").isNull()).alias("orphans"), F.count_if(F.col("g_doc").isNull()).alias("dangling"))


SQL["document_audit"] = f"SELECT coalesce(s.doc_key, g.doc_key) AS doc_key, count(*) FILTER (s.doc_key IS NOT NULL AND coalesce(trim(answer_text), '') = '') AS empty, count(*) FILTER (s.doc_key IS NULL) AS orphans, count(*) FILTER (g.doc_key IS NULL) AS dangling FROM {SUBS} s FULL JOIN (SELECT DISTINCT answer_group_id, doc_key FROM answer_groups) g USING (answer_group_id) GROUP BY 1"


def queue_stats(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").withColumn("failed", F.col("event_type") == "error")
    done = state.retry(rows.withColumn("attempts", (F.col("event_id") % 6).cast("int")), F.col("failed"), "attempts", F.col("ts").cast("timestamp"))
    return done.groupBy("next_status").agg(F.count("*").alias("n"), F.max("next_attempts").alias("attempts"), F.min(F.col("due_at").cast("timestamp_ntz")).alias("first_due"))


SQL["queue_stats"] = "WITH e AS (SELECT ts, event_type = 'error' AS failed, (event_id % 6)::INT + (event_type = 'error')::INT AS n FROM events) SELECT CASE WHEN NOT failed THEN 'done' WHEN n >= 5 THEN 'failed' ELSE 'pending' END AS next_status, count(*) AS n, max(e.n) AS attempts, min(CASE WHEN failed AND e.n < 5 THEN ts + to_seconds(30 * e.n) END) AS first_due FROM e GROUP BY 1"


def claim_order(spark, sf_dir):
    """The next ten jobs by deadline of those due."""
    rows = read_table(spark, sf_dir, "events").where((F.col("event_type") == "error") & (F.col("ts") <= F.lit(AS_OF).cast("timestamp_ntz")))
    return rows.orderBy("ts", "event_id").limit(10).select("event_id", "user_id", "ts")


SQL["claim_order"] = f"SELECT event_id, user_id, ts FROM events WHERE event_type = 'error' AND ts <= TIMESTAMP '{AS_OF}' ORDER BY ts, event_id LIMIT 10"


def purge_candidates(spark, sf_dir):
    cut = F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(10))
    rows = read_table(spark, sf_dir, "events").where(F.col("ts") < cut)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


SQL["purge_candidates"] = f"SELECT user_id, count(*) AS n, max(ts) AS last FROM events WHERE ts < TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY GROUP BY 1"


def liveness(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    age = F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp(F.col("last_seen").cast("timestamp"))
    return rows.select("user_id", age.alias("age"), (age <= 86400).alias("alive"))


SQL["liveness"] = f"SELECT user_id, age, age <= 86400 AS alive FROM (SELECT user_id, (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(max(ts))))::BIGINT AS age FROM events GROUP BY 1)"


def debounce_sessions(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    rows = state.sessions(events, "user_id", "ts", "event_type", 6 * 3600)
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "events", "last_kind")


SQL["debounce_sessions"] = "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g) SELECT user_id, min(ts) AS start, count(*) AS events, arg_max(event_type, (ts, event_type)) AS last_kind FROM i GROUP BY user_id, island"


def rate_limit(spark, sf_dir):
    """Events of a user within the hour up to each event, and whether they exceed three."""
    w = Window.partitionBy("user_id").orderBy("second").rangeBetween(-3600, 0)
    rows = read_table(spark, sf_dir, "events").withColumn("second", F.unix_timestamp(F.col("ts").cast("timestamp")))
    return rows.select("event_id", F.count("*").over(w).alias("recent"), (F.count("*").over(w) > 3).alias("limited"))


SQL["rate_limit"] = "SELECT event_id, count(*) OVER w AS recent, count(*) OVER w > 3 AS limited FROM (SELECT *, floor(epoch(ts))::BIGINT AS second FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY second RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)"


def upload_rollup(spark, sf_dir):
    """State of each customer's orders as one: failed over pending over done."""
    rows = read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "O").alias("o"), F.bool_or(F.col("o_orderstatus") == "P").alias("p"), F.count("*").alias("jobs"))
    return rows.select("o_custkey", F.when(F.col("p"), "partial").when(F.col("o"), "open").otherwise("done").alias("status"), "jobs")


SQL["upload_rollup"] = "SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'partial' WHEN bool_or(o_orderstatus = 'O') THEN 'open' ELSE 'done' END AS status, count(*) AS jobs FROM orders GROUP BY 1"


def positional_attach(spark, sf_dir):
    """Columns of a document's tables dealt to its answer groups in turn."""
    cols = read_table(spark, sf_dir, "table_columns").dropDuplicates(["column_id"]).select("doc_key", "column_id")
    groups = read_table(spark, sf_dir, "answer_groups").dropDuplicates(["answer_group_id"]).select("doc_key", "answer_group_id")
    sizes = groups.groupBy("doc_key").agg(F.count("*").alias("n_groups"))
    c = cols.withColumn("i", F.row_number().over(Window.partitionBy("doc_key").orderBy("column_id")) - 1).join(sizes, "doc_key").withColumn("n", F.col("i") % F.col("n_groups"))
    g = groups.withColumn("n", F.row_number().over(Window.partitionBy("doc_key").orderBy("answer_group_id")) - 1)
    return c.join(g, ["doc_key", "n"]).select("column_id", "answer_group_id")


SQL["positional_attach"] = "WITH c AS (SELECT doc_key, column_id, row_number() OVER (PARTITION BY doc_key ORDER BY column_id) - 1 AS i FROM (SELECT DISTINCT doc_key, column_id FROM table_columns)), g AS (SELECT doc_key, answer_group_id, row_number() OVER (PARTITION BY doc_key ORDER BY answer_group_id) - 1 AS n, count(*) OVER (PARTITION BY doc_key) AS m FROM (SELECT DISTINCT doc_key, answer_group_id FROM answer_groups)) SELECT column_id, answer_group_id FROM c JOIN g ON c.doc_key = g.doc_key AND c.i % g.m = g.n"


def shared_answers(spark, sf_dir):
    """Answer groups numbered by their first part within the document, with the parts that share them."""
    subs = _subs(spark, sf_dir)
    groups = subs.groupBy("doc_key", "answer_group_id").agg(F.min("part_label").alias("first_part"), F.count("*").alias("parts"))
    w = Window.partitionBy("doc_key").orderBy(F.asc_nulls_last("first_part"), "answer_group_id")
    return groups.select("doc_key", "answer_group_id", F.dense_rank().over(w).alias("number"), "parts")


SQL["shared_answers"] = f"SELECT doc_key, answer_group_id, dense_rank() OVER (PARTITION BY doc_key ORDER BY first_part NULLS LAST, answer_group_id) AS number, parts FROM (SELECT doc_key, answer_group_id, min(part_label) AS first_part, count(*) AS parts FROM {SUBS} GROUP BY 1, 2)"


def column_shape(spark, sf_dir):
    """Mean length, distinct share and most frequent name of the columns of each role."""
    cols = read_table(spark, sf_dir, "table_columns").dropDuplicates(["column_id"])
    names = cols.groupBy("role", "name").agg(F.count("*").alias("n"))
    return names.groupBy("role").agg(F.round(F.sum(F.length("name") * F.col("n")) / F.sum(F.when(F.col("name").isNotNull(), F.col("n"))), 6).alias("mean_length"), F.round(F.count("name") / F.sum("n"), 6).alias("distinct_share"), F.max_by("name", F.struct("n", "name")).alias("usual"), F.max("n").alias("usual_n"))


SQL["column_shape"] = "WITH n AS (SELECT role, name, count(*) AS n FROM (SELECT DISTINCT column_id, role, name FROM table_columns) GROUP BY 1, 2) SELECT role, round(sum(length(name) * n) / sum(n) FILTER (name IS NOT NULL), 6) AS mean_length, round(count(name) / sum(n), 6) AS distinct_share, arg_max(name, (n, name)) AS usual, max(n) AS usual_n FROM n GROUP BY 1"


def page_rollup(spark, sf_dir):
    """Kinds of pages of each document, and whether they are mixed."""
    rows = read_table(spark, sf_dir, "page_routes").dropDuplicates(["doc_key", "page"])
    return rows.groupBy("doc_key").agg(F.count_if(F.col("page_type") == "digital").alias("digital"), F.count_if(F.col("page_type") == "scanned").alias("scanned"), F.count_if(F.col("page_type") == "image_based").alias("image_based"), (F.countDistinct("page_type") > 1).alias("mixed"))


SQL["page_rollup"] = "SELECT doc_key, count(*) FILTER (page_type = 'digital') AS digital, count(*) FILTER (page_type = 'scanned') AS scanned, count(*) FILTER (page_type = 'image_based') AS image_based, count(DISTINCT page_type) > 1 AS mixed FROM (SELECT DISTINCT doc_key, page, page_type FROM page_routes) GROUP BY 1"


def page_classify(spark, sf_dir):
    """Pages by their text and image coverage, beside the stored type."""
    rows = read_table(spark, sf_dir, "page_routes").dropDuplicates(["doc_key", "page"])
    made = F.when(F.col("text_chars") >= 200, "digital").when((F.least(F.lit(1.0), F.col("image_coverage")) >= 0.5) & (F.col("text_chars") < 50), "scanned").otherwise("image_based")
    return rows.groupBy(made.alias("made"), "page_type").agg(F.count("*").alias("n"))


SQL["page_classify"] = "SELECT CASE WHEN text_chars >= 200 THEN 'digital' WHEN least(1.0, image_coverage) >= 0.5 AND text_chars < 50 THEN 'scanned' ELSE 'image_based' END AS made, page_type, count(*) AS n FROM (SELECT DISTINCT doc_key, page, page_type, text_chars, image_coverage FROM page_routes) GROUP BY 1, 2"


def scanned_test(spark, sf_dir):
    rows = read_table(spark, sf_dir, "page_routes").dropDuplicates(["doc_key", "page"]).where("page <= 8")
    return rows.groupBy("doc_key").agg((F.sum("text_chars") < 100 * F.count("*")).alias("scanned"))


SQL["scanned_test"] = "SELECT doc_key, sum(text_chars) < 100 * count(*) AS scanned FROM (SELECT DISTINCT doc_key, page, text_chars FROM page_routes) WHERE page <= 8 GROUP BY 1"


def load_warnings(spark, sf_dir):
    """What is amiss with a document, without rejecting it."""
    d = _docs(spark, sf_dir)
    warn = F.filter(F.array(F.when(F.col("subject").isNull(), "no_subject"), F.when(F.col("reply_date").isNull(), "no_reply_date"), F.when(F.col("starred").isNull(), "starred_unknown"), F.when(F.size("diary_numbers") == 0, "no_diary_number")), lambda w: w.isNotNull())
    return d.select("doc_key", F.array_join(warn, ";").alias("warnings")).where("warnings <> ''")


SQL["load_warnings"] = "SELECT doc_key, warnings FROM (SELECT DISTINCT doc_key, concat_ws(';', CASE WHEN subject IS NULL THEN 'no_subject' END, CASE WHEN reply_date IS NULL THEN 'no_reply_date' END, CASE WHEN starred IS NULL THEN 'starred_unknown' END, CASE WHEN len(diary_numbers) = 0 THEN 'no_diary_number' END) AS warnings FROM parsed) WHERE warnings <> ''"


def queries():
    return {name: globals()[name] for name in SQL}


def oracle_sql():
    return SQL
