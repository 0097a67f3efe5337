"""Queries of documents as a whole: references, previews, votes, resumable runs, reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarkash.functions import text as T
from tarkash.sources import read_table

SQL: dict[str, str] = {}


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "parsed").dropDuplicates(["doc_key"])


def _subs(spark, sf_dir):
    return read_table(spark, sf_dir, "sub_questions").dropDuplicates(["sub_question_id"])


def _blocks(spark, sf_dir):
    return read_table(spark, sf_dir, "blocks").dropDuplicates(["block_id"])


def invented_references(spark, sf_dir):
    """Annexures that sub-questions cite and their document does not name."""
    cited = _subs(spark, sf_dir).select("doc_key", "sub_question_id", F.explode("annexure_refs").alias("ref"))
    named = _docs(spark, sf_dir).select("doc_key", F.explode("annexures_referenced").alias("ref")).distinct()
    return cited.join(named, ["doc_key", "ref"], "left_anti").select("sub_question_id", "ref").distinct()


SQL["invented_references"] = "SELECT DISTINCT sub_question_id, ref FROM (SELECT doc_key, sub_question_id, unnest(annexure_refs) AS ref FROM sub_questions) s WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_key, unnest(annexures_referenced) AS ref FROM parsed) p WHERE p.doc_key = s.doc_key AND p.ref = s.ref)"


def uncovered_parts(spark, sf_dir):
    """Documents with parts that have no answer, and their labels."""
    gaps = _subs(spark, sf_dir).where(F.coalesce(F.trim("answer_text"), F.lit("")) == "")
    return gaps.groupBy("doc_key").agg(F.count("*").alias("gaps"), F.array_join(F.array_sort(F.collect_set("part_label")), ",").alias("labels"))


SQL["uncovered_parts"] = "SELECT doc_key, count(*) AS gaps, coalesce(string_agg(DISTINCT part_label, ',' ORDER BY part_label), '') AS labels FROM (SELECT DISTINCT sub_question_id, doc_key, part_label, answer_text FROM sub_questions) WHERE coalesce(trim(answer_text), '') = '' GROUP BY 1"


def table_preview(spark, sf_dir):
    """The first six column names of each table, each cut to 28 characters."""
    cols = read_table(spark, sf_dir, "table_columns").dropDuplicates(["column_id"]).where("column_index < 6")
    listed = cols.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("column_index", F.substring(F.coalesce(T.collapse(F.col("name")), F.lit("")), 1, 28).alias("name")))).alias("c"))
    return listed.select("table_id", F.array_join(F.transform("c", lambda x: x["name"]), " | ").alias("preview"))


SQL["table_preview"] = "SELECT table_id, string_agg(left(coalesce(trim(regexp_replace(name, '\\s+', ' ', 'g')), ''), 28), ' | ' ORDER BY column_index) AS preview FROM (SELECT DISTINCT column_id, table_id, column_index, name FROM table_columns) WHERE column_index < 6 GROUP BY 1"


def document_context(spark, sf_dir):
    """Each document with its tables' roles in order: what a draft would quote."""
    cols = read_table(spark, sf_dir, "table_columns").dropDuplicates(["column_id"])
    tables = cols.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("table_id", "column_index", "role"))).alias("c"))
    joined = _docs(spark, sf_dir).select("doc_key", "subject").join(tables, "doc_key", "left")
    line = F.array_join(F.transform("c", lambda x: F.coalesce(x["role"], F.lit("?"))), ",")
    return joined.select("doc_key", F.concat_ws(": ", F.coalesce("subject", F.lit("(none)")), F.coalesce(line, F.lit(""))).alias("context"))


SQL["document_context"] = "WITH t AS (SELECT doc_key, string_agg(coalesce(role, '?'), ',' ORDER BY table_id, column_index, role) AS line FROM (SELECT DISTINCT column_id, table_id, doc_key, column_index, role FROM table_columns) GROUP BY 1) SELECT d.doc_key, coalesce(subject, '(none)') || ': ' || coalesce(line, '') AS context FROM (SELECT DISTINCT doc_key, subject FROM parsed) d LEFT JOIN t USING (doc_key)"


def votes_latest(spark, sf_dir):
    """The last vote of each user on each customer; votes on customers without an order do not count."""
    votes = read_table(spark, sf_dir, "events").where("event_type IN ('click', 'view', 'error')").select("event_id", "user_id", (F.col("event_id") % (F.col("user_id") + 7)).alias("customer"), "event_type", "ts")
    customers, orders = read_table(spark, sf_dir, "customer").select("c_custkey"), read_table(spark, sf_dir, "orders").select("o_custkey").distinct()
    shown = customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").alias("customer"))
    valid = votes.join(shown, "customer", "left_semi")
    last = valid.groupBy("user_id", "customer").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("v"))
    return last.select("user_id", "customer", "v.event_id", F.col("v.event_type").alias("verdict"))


SQL["votes_latest"] = "WITH v AS (SELECT event_id, user_id, event_id % (user_id + 7) AS customer, event_type, ts FROM events WHERE event_type IN ('click', 'view', 'error')) SELECT user_id, customer, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS verdict FROM v WHERE EXISTS (SELECT 1 FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey = v.customer) GROUP BY 1, 2"


def resumable_run(spark, sf_dir):
    """Questions still to be run: those whose answers are not recorded yet."""
    done = _subs(spark, sf_dir).where("embedding IS NOT NULL AND confidence = 'high'").select("sub_question_id")
    return _subs(spark, sf_dir).select("sub_question_id", "doc_key").join(done, "sub_question_id", "left_anti")


SQL["resumable_run"] = "SELECT DISTINCT sub_question_id, doc_key FROM sub_questions WHERE NOT (embedding IS NOT NULL AND coalesce(confidence = 'high', false))"


def layout_signals(spark, sf_dir):
    """Signals of a document's layout from its blocks: kinds, markers, length, and the class that they make."""
    text = F.coalesce("text", F.lit(""))
    marks = F.size(F.regexp_extract_all(text, F.lit(r"\([a-z]\)"), 0))
    rows = _blocks(spark, sf_dir).groupBy("doc_key").agg(F.count("*").alias("blocks"), F.count_if(F.col("kind") == "list_item").alias("items"), F.count_if(F.col("kind") == "heading").alias("headings"), F.sum(marks).alias("markers"), F.sum(F.length(text)).alias("chars"))
    kind = F.when(F.col("markers") >= 5, "parts").when(F.col("items") * 2 >= F.col("blocks"), "list").when(F.col("chars") < 500, "short").otherwise("prose")
    return rows.withColumn("layout", kind)


SQL["layout_signals"] = "SELECT *, CASE WHEN markers >= 5 THEN 'parts' WHEN items * 2 >= blocks THEN 'list' WHEN chars < 500 THEN 'short' ELSE 'prose' END AS layout FROM (SELECT doc_key, count(*) AS blocks, count(*) FILTER (kind = 'list_item') AS items, count(*) FILTER (kind = 'heading') AS headings, sum(len(regexp_extract_all(coalesce(text, ''), '\\([a-z]\\)')))::BIGINT AS markers, sum(length(coalesce(text, '')))::BIGINT AS chars FROM (SELECT DISTINCT block_id, doc_key, kind, text FROM blocks) GROUP BY 1)"


def marker_stripped(spark, sf_dir):
    """List items without their marker, and the marker."""
    marker = r"^\s*(\(?(?:[a-z]|\d{1,3}|[ivx]{1,4})[.)])\s+"
    rows = _blocks(spark, sf_dir).where("kind = 'list_item' AND text IS NOT NULL")
    return rows.select("block_id", F.regexp_extract("text", marker, 1).alias("marker"), F.length(F.regexp_replace("text", marker, "")).alias("chars"))


SQL["marker_stripped"] = "SELECT block_id, regexp_extract(text, '^\\s*(\\(?(?:[a-z]|\\d{1,3}|[ivx]{1,4})[.)])\\s+', 1) AS marker, length(regexp_replace(text, '^\\s*(\\(?(?:[a-z]|\\d{1,3}|[ivx]{1,4})[.)])\\s+', '')) AS chars FROM (SELECT DISTINCT block_id, kind, text FROM blocks) WHERE kind = 'list_item' AND text IS NOT NULL"


def reading_order(spark, sf_dir):
    """Blocks numbered within their page, and how many characters of their document precede each."""
    page = Window.partitionBy("doc_key", "page").orderBy("seq")
    rows = _blocks(spark, sf_dir)
    sizes = rows.groupBy("doc_key", "page").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))  # a row a page, not a block
    before = sizes.select("doc_key", "page", (F.sum("chars").over(Window.partitionBy("doc_key").orderBy("page")) - F.col("chars")).alias("before"))
    within = rows.select("block_id", "doc_key", "page", F.row_number().over(page).alias("number"), (F.sum(F.length(F.coalesce("text", F.lit("")))).over(page) - F.length(F.coalesce("text", F.lit("")))).alias("in_page"))
    return within.join(before, ["doc_key", "page"]).select("block_id", "number", (F.col("before") + F.col("in_page")).alias("offset"))


SQL["reading_order"] = "WITH b AS (SELECT DISTINCT block_id, doc_key, page, seq, length(coalesce(text, '')) AS n FROM blocks) SELECT block_id, row_number() OVER (PARTITION BY doc_key, page ORDER BY seq) AS number, (sum(n) OVER (PARTITION BY doc_key ORDER BY page, seq) - n)::BIGINT AS offset FROM b"


def metrics_diff(spark, sf_dir):
    """Share of answered sub-questions of each house in two sessions' years, side by side."""
    rows = _subs(spark, sf_dir).join(_docs(spark, sf_dir).select("doc_key", "house", F.substring("session", 1, 4).alias("year")), "doc_key")
    share = rows.groupBy("house", "year").agg(F.round(F.avg((F.coalesce(F.trim("answer_text"), F.lit("")) != "").cast("double")), 6).alias("answered"))
    a, b = share.where("year = '2020'").select("house", F.col("answered").alias("before")), share.where("year = '2023'").select("house", F.col("answered").alias("after"))
    return a.join(b, "house", "full").withColumn("change", F.round(F.col("after") - F.col("before"), 6))


SQL["metrics_diff"] = "WITH s AS (SELECT d.house, left(d.session, 4) AS year, round(avg((coalesce(trim(answer_text), '') <> '')::INT), 6) AS answered FROM (SELECT DISTINCT sub_question_id, doc_key, answer_text FROM sub_questions) q JOIN (SELECT DISTINCT doc_key, house, session FROM parsed) d USING (doc_key) GROUP BY 1, 2), a AS (SELECT house, answered AS before FROM s WHERE year = '2020'), b AS (SELECT house, answered AS after FROM s WHERE year = '2023') SELECT house, before, after, round(after - before, 6) AS change FROM a FULL JOIN b USING (house)"


def sampled_documents(spark, sf_dir):
    """Three documents in ten, by a seeded sample of rows."""
    return read_table(spark, sf_dir, "documents").select("doc_id", "source").sample(0.3, seed=42)


def queries():
    return {name: globals()[name] for name in SQL} | {"sampled_documents": sampled_documents}


def oracle_sql():
    return SQL
