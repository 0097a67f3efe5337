"""Queries of reply signals, model output, table shapes, folders and changes of state, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarkash.functions import replies as P
from tarkash.functions import text as T
from tarkash.operators import crawl, dictionary, grids, state
from tarkash.sources import documents as nested
from tarkash.sources import read_table

SQL: dict[str, str] = {}
AS_OF = "2024-01-20 00:00:00"


def _docs(spark, sf_dir, *columns):
    return read_table(spark, sf_dir, "parsed").select("doc_key", *columns).dropDuplicates(["doc_key"])


def _subs(spark, sf_dir, *columns):
    return read_table(spark, sf_dir, "sub_questions").select("sub_question_id", *columns).dropDuplicates(["sub_question_id"])


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def reply_signals(spark, sf_dir):
    """What each document's text says of itself."""
    rows = read_table(spark, sf_dir, "documents").where("text IS NOT NULL")
    text = F.col("text")
    return rows.select("doc_id", P.starred_of(text).alias("starred"), P.subject_of(text).alias("subject"), P.points_to_table(text).alias("below"), P.is_mail_wrapper(text).alias("mail"))


HEAD = "lower(left(text, 1200))"
MAIL = " + ".join(f"regexp_matches({HEAD}, '\\b{h}\\s*:')::INT" for h in P.MAIL_HEADERS)
SQL["reply_signals"] = f"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\\bunstarred\\b') THEN false WHEN regexp_matches(text, '(?i)\\bstarred\\b') THEN true END AS starred,
 nullif(trim(regexp_extract(text, '(?i)(?:\\bregarding\\b|\\bsubject\\s*[:-]|\\bon the subject\\b)[ \\t]*[''\"]?([^''\"\\n]{{4,120}})', 1)), '') AS subject,
 regexp_matches(text, '{P.BELOW}') AND NOT regexp_matches(text, '(?i)annex(?:ure)?\\.?\\s*[-\\s]?\\s*([IVXLC]+|\\d+|[A-H])\\b') AS below,
 signs >= 3 OR signs = 2 AND length(trim(text)) < 1800 AS mail
 FROM (SELECT *, (({MAIL}) >= 2)::INT + regexp_matches(text, '(?i)\\b[0-9]+\\s+attachments?\\b|\\.(?:docx?|pdf|xlsx?)\\s+[0-9]+\\s*[KM]B')::INT + regexp_matches({HEAD}, '\\b(?:fwd|re):\\s')::INT AS signs FROM documents WHERE text IS NOT NULL)"""


def listed_numbers(spark, sf_dir):
    """Diary numbers read back from a line that lists those of each document."""
    line = F.concat(F.lit("Reply to Diary No. "), F.array_join("diary_numbers", " & "))
    return _docs(spark, sf_dir, "diary_numbers").select("doc_key", F.array_join(F.array_sort(P.diary_numbers(line)), ",").alias("numbers"))


SQL["listed_numbers"] = "SELECT doc_key, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(regexp_extract('Reply to Diary No. ' || array_to_string(diary_numbers, ' & '), '(?i)(?:\\bdiary|\\bdy\\.?|\\bquestion)\\s*(?:dy\\.?\\s*)?no\\.?s?\\s*[:.]?\\s*([A-Z]?-?[0-9]{2,6}(?:\\s*(?:,|&|and|/)\\s*[A-Z]?-?[0-9]{2,6})*)', 1), '(?i)([A-Z]?-?[0-9]{2,6})', 1), lambda x: upper(x)))), ',') AS numbers FROM (SELECT DISTINCT doc_key, diary_numbers FROM parsed)"


def question_numbers(spark, sf_dir):
    """The number of each sub-question's question: stated as its part label, as a number, or as its text."""
    rows = _subs(spark, sf_dir, "question_id", "part_label", "question_text")
    n = F.length("sub_question_id") % 3
    raw = F.when(n == 0, F.col("part_label")).when(n == 1, F.regexp_extract("question_id", r"([0-9]+)", 1)).otherwise(F.col("question_text"))
    return rows.select("sub_question_id", P.question_number(raw, F.col("question_id")).alias("q")).select("sub_question_id", "q.number", "q.label")


SQL["question_numbers"] = """SELECT sub_question_id, CASE WHEN regexp_matches(s, '^[A-Za-z]{0,4}[- ]?[0-9]{1,6}[A-Za-z]?$') THEN s ELSE coalesce(nullif(question_id, ''), nullif(s, ''), 'unknown') END AS number, CASE WHEN regexp_matches(s, '(?i)^\\(?(?:[a-z]|[ivx]{1,4})\\)?$') THEN s END AS label
 FROM (SELECT DISTINCT sub_question_id, question_id, trim(coalesce(CASE length(sub_question_id) % 3 WHEN 0 THEN part_label WHEN 1 THEN regexp_extract(question_id, '([0-9]+)', 1) ELSE question_text END, '')) AS s FROM sub_questions)"""


def marked_bodies(spark, sf_dir):
    """Question and answer of one text, parted at the first mark of an answer."""
    rows = _subs(spark, sf_dir, "question_text", "answer_text").where("question_text IS NOT NULL AND answer_text IS NOT NULL")
    text = F.concat("question_text", F.lit("\nReply: "), "answer_text")
    return rows.select("sub_question_id", F.length(P.before_mark(text)).alias("question"), F.length(P.after_mark(text)).alias("answer"))


SQL["marked_bodies"] = "SELECT sub_question_id, length(trim(b)) AS question, length(trim(substr(t, length(b) + length(m) + 1))) AS answer FROM (SELECT *, regexp_extract(t, '(?is)^(.*?)(\\b(?:comment|answer|reply)\\b\\s*[:.-])', 1) AS b, regexp_extract(t, '(?is)^(.*?)(\\b(?:comment|answer|reply)\\b\\s*[:.-])', 2) AS m FROM (SELECT DISTINCT sub_question_id, question_text || chr(10) || 'Reply: ' || answer_text AS t FROM sub_questions WHERE question_text IS NOT NULL AND answer_text IS NOT NULL))"


def iso_times(spark, sf_dir):
    """Event times written as text in several ways, some of them no times, and read again."""
    ts = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    n = F.col("event_id") % 4
    raw = F.when(n == 0, F.concat(ts, F.lit("Z"))).when(n == 1, ts).when(n == 2, F.concat(F.lit("about "), ts)).otherwise(F.concat(ts, F.lit("+05:30")))
    return read_table(spark, sf_dir, "events").select("event_id", P.iso_time(raw).cast("timestamp_ntz").alias("at"))


SQL["iso_times"] = "SELECT event_id, CASE event_id % 4 WHEN 2 THEN NULL WHEN 3 THEN date_trunc('second', ts) - INTERVAL 330 MINUTE ELSE date_trunc('second', ts) END AS at FROM events"


def allowed_values(spark, sf_dir):
    """Answer types and confidences, those not allowed as NULL."""
    rows = read_table(spark, sf_dir, "answer_groups").select("answer_group_id", "answer_type", "confidence").dropDuplicates(["answer_group_id"])
    return rows.select("answer_group_id", P.one_of(F.col("answer_type"), ("substantive", "nil")).alias("answer_type"), P.one_of(F.lower("confidence"), ("high", "low")).alias("confidence"))


SQL["allowed_values"] = "SELECT DISTINCT answer_group_id, CASE WHEN answer_type IN ('substantive', 'nil') THEN answer_type END AS answer_type, CASE WHEN lower(confidence) IN ('high', 'low') THEN lower(confidence) END AS confidence FROM answer_groups"


def verdict_arrays(spark, sf_dir):
    """Verdicts that each user's events would give as fenced JSON, read item by item."""
    item = F.format_string('{"id": %d, "verdict": "%s", "reason": "%s"}', F.col("event_id"), F.when(F.col("event_type") == "click", "Similar").when(F.col("event_type") == "view", "not_similar").otherwise("perhaps"), F.col("event_type"))
    raw = read_table(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / 50).alias("batch"), item.alias("i")).groupBy("user_id", "batch").agg(F.concat(F.lit("```json\n["), F.array_join(F.collect_list("i"), ","), F.lit("]\n```")).alias("raw"))  # at most fifty events
    return raw.select("user_id", F.explode(P.verdicts(F.col("raw"))).alias("v")).select("user_id", F.col("v.id").cast("bigint").alias("event_id"), "v.verdict", "v.reason")


SQL["verdict_arrays"] = "SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'similar' ELSE 'not_similar' END AS verdict, event_type AS reason FROM events WHERE event_type IN ('click', 'view')"


def tolerant_json(spark, sf_dir):
    """A number read from event properties that are fenced, prefixed by talk, or cut off at their end."""
    n = F.col("event_id") % 4
    cut = F.col("props").substr(F.lit(1), F.length("props") - 1)
    raw = F.when(n == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(n == 1, F.concat(F.lit("Here it is: "), F.col("props"))).when(n == 2, cut).otherwise(F.concat(cut, F.lit(', "more": ["a", "b')))
    return read_table(spark, sf_dir, "events").where("props IS NOT NULL").select("event_id", F.from_json(P.closed_json(raw), "k int")["k"].alias("k"))


SQL["tolerant_json"] = "SELECT event_id, (props::JSON ->> 'k')::INT AS k FROM events WHERE props IS NOT NULL"


def pair_checks(spark, sf_dir):
    """What the pairs of each sub-question lack, read from JSON in which NULL fields are left out."""
    pair = F.struct(F.col("question_id").alias("question_number"), "question_text", "answer_text", "confidence")
    raw = F.to_json(F.struct(F.array(pair).alias("pairs")))
    return _subs(spark, sf_dir, "question_id", "question_text", "answer_text", "confidence").select("sub_question_id", F.array_join(P.pair_errors(raw), ";").alias("errors"))


SQL["pair_checks"] = "SELECT DISTINCT sub_question_id, concat_ws(';', CASE WHEN question_id IS NULL THEN '0:question_number' END, CASE WHEN question_text IS NULL THEN '0:question_text' END, CASE WHEN answer_text IS NULL THEN '0:answer_text' END, CASE WHEN coalesce(confidence, 'high') NOT IN ('high', 'low') THEN '0:confidence' END) AS errors FROM sub_questions"


def model_entities(spark, sf_dir):
    """Entities that a model would give for each part: kinds and names checked."""
    raw = F.format_string('Found: [{"name": "%s", "type": "%s"}, {"name": "Dam", "type": "project"}]', F.col("p_name"), F.when(F.col("p_size") % 2 == 0, "Project").otherwise("river"))
    return read_table(spark, sf_dir, "part").select("p_partkey", F.explode(P.model_entities(raw)).alias("e")).select("p_partkey", "e.name", "e.kind")


SQL["model_entities"] = "SELECT p_partkey, trim(p_name) AS name, 'project' AS kind FROM part WHERE p_size % 2 = 0 AND length(trim(p_name)) >= 4"


def review_reasons(spark, sf_dir):
    """Documents with flags that call for a review."""
    return _docs(spark, sf_dir, "extraction_flags").select("doc_key", F.array_join(F.array_sort(P.review_reasons(F.col("extraction_flags"))), ";").alias("reasons"), (F.size(P.review_reasons(F.col("extraction_flags"))) > 0).alias("review"))


SQL["review_reasons"] = f"SELECT doc_key, array_to_string(list_sort(list_intersect(extraction_flags, {list(P.REVIEW_FLAGS)})), ';') AS reasons, len(list_intersect(extraction_flags, {list(P.REVIEW_FLAGS)})) > 0 AS review FROM (SELECT DISTINCT doc_key, extraction_flags FROM parsed)"


def table_directions(spark, sf_dir):
    """Whether each order's lines, as a grid, stand in rows or are transposed."""
    lines = read_table(spark, sf_dir, "lineitem")
    n = F.col("l_orderkey") % 3
    first = F.when(n == 0, F.col("l_quantity").cast("string")).when(n == 1, F.concat(F.col("l_linenumber").cast("string"), F.lit(" Design energy"))).otherwise(F.when(F.col("l_linenumber") % 2 == 0, "1,200").otherwise("Date of sanction"))
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus", first.alias("f")))).alias("r"))  # at most seven lines
    title = F.lit("Salient details of all projects of the year")
    header = F.when(F.col("l_orderkey") % 7 == 0, F.array(title, title, title, F.lit(""))).otherwise(F.array(*map(F.lit, ("no", "flag", "status", "x"))))
    grid = F.concat(F.array(header), F.transform("r", lambda x: F.array(x["f"], x["l_returnflag"], x["l_linestatus"], F.lit(""))))
    return rows.select("l_orderkey", grids.orientation(grid).alias("direction"))


SQL["table_directions"] = "WITH f AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linenumber % 2 = 1) AS odd FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN n < 2 THEN 'rows' WHEN l_orderkey % 7 = 0 THEN 'transposed' WHEN l_orderkey % 3 = 1 AND n >= 3 THEN 'transposed' WHEN l_orderkey % 3 = 2 AND odd >= greatest(3, 0.7 * n) THEN 'transposed' ELSE 'rows' END AS direction FROM f"


def clean_headers(spark, sf_dir):
    """Each order's lines under a header of two rows, one column of which is split over two: the cleaned grid as text."""
    lines = read_table(spark, sf_dir, "lineitem")
    odd = F.col("l_linenumber") % 2 == 1
    row = F.array(F.col("l_linenumber").cast("string"), F.when(odd, F.col("l_returnflag")).otherwise(""), F.when(odd, "").otherwise(F.col("l_returnflag")), F.col("l_linestatus"))
    made = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus", row.alias("row")))).alias("r"))  # at most seven lines
    grid = F.concat(F.array(F.array(*map(F.lit, ("no", "flag", "", "status"))), F.array(*map(F.lit, ("", "of line", "", "now")))), F.transform("r", lambda x: x["row"]))
    done = grids.merge_split_columns(grids.merge_header(grid))
    return made.select("l_orderkey", F.array_join(F.transform(done, lambda r: F.array_join(r, "|")), "/").alias("grid"))


SQL["clean_headers"] = "SELECT l_orderkey, 'no|flag of line|status now/' || string_agg(l_linenumber || '|' || l_returnflag || '|' || l_linestatus, '/' ORDER BY l_linenumber, l_returnflag, l_linestatus) AS grid FROM lineitem GROUP BY 1"


def entity_columns(spark, sf_dir):
    """Names of the columns of projects and places of each table, and whether the table is an answer of its own."""
    cols = read_table(spark, sf_dir, "table_columns").select("column_id", "table_id", "column_index", "name", "role").dropDuplicates(["column_id"]).where("name IS NOT NULL")
    rows = cols.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("column_index", T.collapse(F.col("name")).alias("name"), "role"))).alias("c"), F.count("*").alias("n"), F.sum(F.length("name")).alias("chars"))  # the columns of a table
    named = F.transform(F.filter("c", lambda x: x["role"].isin("project_name", "location")), lambda x: x["name"])
    return rows.select("table_id", F.array_join(named, ";").alias("entities"), grids.is_answer(F.transform("c", lambda x: x["role"]), F.col("n"), F.col("chars"), F.lit(200)).alias("answer"))


SQL["entity_columns"] = "SELECT table_id, coalesce(string_agg(trim(regexp_replace(name, '\\s+', ' ', 'g')), ';' ORDER BY column_index) FILTER (role IN ('project_name', 'location')), '') AS entities, coalesce(bool_or(role IN ('project_name', 'location', 'status')), false) AND count(*) >= 2 AND sum(length(name)) >= 60 AS answer FROM (SELECT DISTINCT column_id, table_id, column_index, name, role FROM table_columns WHERE name IS NOT NULL) GROUP BY 1"


def annexure_files(spark, sf_dir):
    """Which file each named annexure is: files are made from the names, some of them missing, twice there or without a number."""
    refs = _docs(spark, sf_dir, "annexures_referenced", "page_count").select("doc_key", "page_count", F.explode("annexures_referenced").alias("label")).distinct()
    n = T.label_number(F.substring_index("label", "-", -1))
    kinds = F.when(F.col("page_count") % 3 == 0, F.array(F.lit(".docx"), F.lit(".pdf"))).when(F.col("page_count") % 3 == 1, F.array(F.lit(".docx"))).otherwise(F.array().cast("array<string>"))
    made = refs.where(n.isNotNull()).select("doc_key", F.explode(kinds).alias("kind"), "label").select("doc_key", F.concat(F.lower("label"), F.col("kind")).alias("file"))
    found = crawl.resolve_annexures(refs.select("doc_key", "label"), made, "doc_key", "label", "file")
    return found.select("doc_key", "label", "file", "confidence")


NUMBER = "CASE WHEN regexp_matches(x, '^\\d+$') THEN x::INT WHEN list_position(['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI','XVII','XVIII','XIX','XX'], x) > 0 THEN list_position(['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI','XVII','XVIII','XIX','XX'], x) WHEN regexp_matches(x, '^[A-Z]$') THEN ascii(x) - 64 END"
SQL["annexure_files"] = f"SELECT doc_key, label, CASE WHEN n IS NOT NULL AND page_count % 3 < 2 THEN lower(label) || CASE page_count % 3 WHEN 0 THEN '.pdf' ELSE '.docx' END END AS file, CASE WHEN n IS NULL OR page_count % 3 = 2 OR page_count IS NULL THEN 'none' WHEN page_count % 3 = 0 THEN 'low' ELSE 'high' END AS confidence FROM (SELECT *, {NUMBER} AS n FROM (SELECT DISTINCT doc_key, page_count, label, upper(trim(split_part(label, '-', -1))) AS x FROM (SELECT doc_key, page_count, unnest(annexures_referenced) AS label FROM parsed)))"


def question_folders(spark, sf_dir):
    """Folders of the source tree: what is left of their path without houses and states, whether they hold a reply, and how deep a question lies."""
    rows = _docs(spark, sf_dir, "file_metadata").select("doc_key", F.col("file_metadata.relative_path").alias("path"))
    return crawl.folders(rows, "path", tuple(T.HOUSES.values())).select("folder", "kept", "files", "reply", "depth")


SQL["question_folders"] = "WITH p AS (SELECT DISTINCT doc_key, file_metadata.relative_path AS path FROM parsed), f AS (SELECT *, string_split(path, '/') AS s FROM p), g AS (SELECT array_to_string(s[1:len(s) - 1], '/') AS folder, s[1:len(s) - 1] AS q, lower(s[-1]) AS name FROM f WHERE NOT regexp_matches(path, '(^|/)[._]')) SELECT folder, array_to_string(list_filter(q, lambda x: lower(x) NOT IN ('lok_sabha', 'rajya_sabha', 'vidhan_sabha')), '/') AS kept, count(*) AS files, bool_or(regexp_matches(name, '(reply|answer)')) AS reply, coalesce(list_position(list_transform(q, lambda x: regexp_matches(x, '[0-9]') AND NOT regexp_matches(x, '^[0-9]{4}')), true), 0) AS depth FROM g GROUP BY folder, q"


def listing_order(spark, sf_dir):
    """Files of each folder in the order of a listing, without regard to case."""
    f = F.col("file_metadata")
    rows = _docs(spark, sf_dir, "file_metadata").select("doc_key", F.regexp_replace(f["relative_path"], "/[^/]*$", "").alias("folder"), f["original_filename"].alias("name"))
    return rows.select("doc_key", F.row_number().over(Window.partitionBy("folder").orderBy(F.lower("name"), "name", "doc_key")).alias("place"))


SQL["listing_order"] = "SELECT doc_key, row_number() OVER (PARTITION BY regexp_replace(m.relative_path, '/[^/]*$', '') ORDER BY lower(m.original_filename), m.original_filename, doc_key) AS place FROM (SELECT DISTINCT doc_key, file_metadata AS m FROM parsed)"


def place_names(spark, sf_dir):
    """Parts of document keys that could be a state's folder."""
    rows = _docs(spark, sf_dir).select(F.explode(F.split("doc_key", "/")).alias("name")).distinct()
    return rows.unionByName(_docs(spark, sf_dir, "state").select(F.col("state").alias("name")).where("name IS NOT NULL")).distinct().select("name", P.looks_like_place(F.col("name")).alias("place"))


SQL["place_names"] = f"SELECT DISTINCT name, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) NOT IN {_list(P.REPLY_FOLDERS)} AND regexp_matches(lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))), '^[a-z&. ]{{2,}}$') AS place FROM (SELECT unnest(string_split(doc_key, '/')) AS name FROM parsed UNION SELECT state FROM parsed WHERE state IS NOT NULL)"


def stale_claims(spark, sf_dir):
    """Claims of jobs that are a day old or older, by what becomes of them."""
    jobs = read_table(spark, sf_dir, "events").select("event_id", "ts", (F.col("event_id") % 7).cast("int").alias("attempts"))
    done = state.recover_stale(jobs, "ts", F.lit(AS_OF).cast("timestamp"), 86400, "attempts")
    return done.groupBy("recovered_status").agg(F.count("*").alias("n"), F.max("attempts").alias("attempts"))


SQL["stale_claims"] = f"SELECT CASE WHEN NOT epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ts)) > 86400 THEN 'claimed' WHEN event_id % 7 >= 5 THEN 'failed' ELSE 'pending' END AS recovered_status, count(*) AS n, max(event_id % 7)::INT AS attempts FROM events GROUP BY 1"


def reappeared_paths(spark, sf_dir):
    """Deletes of customers' folders by what they mean once they are due: customers with orders are there again."""
    deletes = read_table(spark, sf_dir, "customer").select("c_custkey")
    listing = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return state.resolve_deletes(deletes, listing, ["c_custkey"]).groupBy("action").agg(F.count("*").alias("n"))


SQL["reappeared_paths"] = "SELECT CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'upsert' ELSE 'delete' END AS action, count(*) AS n FROM customer GROUP BY 1"


def file_moves(spark, sf_dir):
    """File events as jobs: moves are two, folders none."""
    path = lambda p: F.concat(F.lit(p), F.col("user_id").cast("string"), F.when(F.col("event_id") % 5 == 0, "/").otherwise(""))
    kind = F.when(F.col("event_type") == "click", "moved").when(F.col("event_type") == "error", "deleted").otherwise("created")
    events = read_table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), path("a/").alias("source"), path("b/").alias("target"))
    return state.split_moves(events, "kind", "source", "target").groupBy("path", "action").agg(F.count("*").alias("n"))


SQL["file_moves"] = "WITH e AS (SELECT event_type, user_id::VARCHAR || CASE WHEN event_id % 5 = 0 THEN '/' ELSE '' END AS p FROM events) SELECT path, action, count(*) AS n FROM (SELECT 'a/' || p AS path, CASE WHEN event_type IN ('click', 'error') THEN 'delete' ELSE 'upsert' END AS action FROM e UNION ALL SELECT 'b/' || p, 'upsert' FROM e WHERE event_type = 'click') WHERE NOT path LIKE '%/' GROUP BY 1, 2"


def partial_upsert(spark, sf_dir):
    """Customers' segment and balance overwritten by their last order's priority and price, where they have one."""
    old = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"), F.round("c_acctbal", 2).alias("balance"), "c_nationkey")
    new = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderpriority").alias("segment"), F.max(F.when(F.col("o_orderstatus") == "F", F.round("o_totalprice", 2))).alias("balance"))
    return state.patch(old, new, ["k"], ["segment", "balance"])


SQL["partial_upsert"] = "SELECT coalesce(c_custkey, k) AS k, coalesce(o.segment, c_mktsegment) AS segment, coalesce(o.balance, round(c_acctbal, 2)) AS balance, c_nationkey FROM customer FULL JOIN (SELECT o_custkey AS k, max(o_orderpriority) AS segment, max(CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice, 2) END) AS balance FROM orders GROUP BY 1) o ON c_custkey = k"


def reactivations(spark, sf_dir):
    """Documents of one page are taken out, scanned ones come back, and the log tells which."""
    docs = _docs(spark, sf_dir, "session", "page_count", "ocr_used")
    at = F.lit(AS_OF).cast("timestamp")
    gone = state.soft_delete(docs, docs.where("page_count = 1"), ["doc_key"], "source_removed", at)
    rows, log = state.reactivate(gone, docs.where("ocr_used"), ["doc_key"], at)
    left = rows.groupBy("session").agg(F.count_if("active").alias("active"), F.count("deleted_at").alias("deleted"))
    return left.join(log.join(docs.select("doc_key", "session"), "doc_key").groupBy("session").agg(F.count("*").alias("logged")), "session", "left").select("session", "active", "deleted", F.coalesce("logged", F.lit(0)).alias("logged"))


SQL["reactivations"] = "SELECT session, count(*) FILTER (page_count IS DISTINCT FROM 1 OR ocr_used) AS active, count(*) FILTER (page_count = 1 AND ocr_used IS NOT TRUE) AS deleted, count(*) FILTER (page_count = 1 AND ocr_used) AS logged FROM (SELECT DISTINCT doc_key, session, page_count, ocr_used FROM parsed) GROUP BY 1"


def refused_deletes(spark, sf_dir):
    """Deletes of paths by how deep they lie: whole sessions are refused."""
    parts = F.split("doc_key", "/")
    paths = _docs(spark, sf_dir).select(F.explode(F.array(F.get(parts, F.lit(0)), F.array_join(F.slice(parts, 1, 2), "/"), F.col("doc_key"))).alias("path")).distinct()
    return paths.select(F.size(F.split("path", "/")).alias("depth")).groupBy((F.col("depth") < 2).alias("refused"), "depth").agg(F.count("*").alias("n"))


SQL["refused_deletes"] = "SELECT depth < 2 AS refused, depth, count(*) AS n FROM (SELECT DISTINCT path, len(string_split(path, '/'))::INT AS depth FROM (SELECT unnest([split_part(doc_key, '/', 1), split_part(doc_key, '/', 1) || '/' || split_part(doc_key, '/', 2), doc_key]) AS path FROM parsed)) GROUP BY 1, 2"


def invalidated_vectors(spark, sf_dir):
    """Sub-questions whose text was reloaded in another form lose their vector."""
    old = _subs(spark, sf_dir, "question_text", "embedding")
    new = old.where(F.length("sub_question_id") % 2 == 0).select("sub_question_id", F.trim("question_text").alias("question_text"))
    done = state.invalidated(old, new.withColumn("question_text", F.when(F.length("question_text") % 2 == 0, F.upper("question_text")).otherwise(F.col("question_text"))), "sub_question_id", "question_text", "embedding")
    return done.select("sub_question_id", F.md5("question_text").alias("text"), F.col("embedding").isNotNull().alias("vector"))


SQL["invalidated_vectors"] = "SELECT sub_question_id, md5(n) AS text, embedding IS NOT NULL AND n IS NOT DISTINCT FROM question_text AS vector FROM (SELECT *, CASE WHEN length(sub_question_id) % 2 = 0 THEN CASE WHEN length(trim(question_text)) % 2 = 0 THEN upper(trim(question_text)) ELSE trim(question_text) END ELSE question_text END AS n FROM (SELECT DISTINCT sub_question_id, question_text, embedding FROM sub_questions))"


def replaced_children(spark, sf_dir):
    """Lines of reopened orders give way to one new line each; other orders keep theirs."""
    old = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    new = read_table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).cast(old.schema["l_linenumber"].dataType).alias("l_linenumber"))
    return state.replace_children(old, new, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("lines"))


SQL["replaced_children"] = "SELECT l_orderkey, count(*) AS lines FROM (SELECT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1"


def recorded_names(spark, sf_dir):
    """Documents loaded again under another source keep the source under which their content was recorded first."""
    rows = read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("hash"), "source")
    return state.keep_names(rows, rows.where("source IS NOT NULL"), "hash", "source").select("doc_id", "source")


SQL["recorded_names"] = "SELECT doc_id, coalesce(n, source) AS source FROM (SELECT doc_id, source, min(source) OVER (PARTITION BY sha256(text)) AS n FROM documents WHERE text IS NOT NULL)"


def trace_rows(spark, sf_dir):
    """Events as the steps of their user's run, each with its time to the next and its payload."""
    rows = read_table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), "event_id", "event_type")
    steps = state.trace_steps(rows, "user_id", "at")
    return steps.select("user_id", "step", "seconds", F.to_json(F.struct(F.col("event_type").alias("node"), F.col("event_id").alias("id"))).alias("payload"))


SQL["trace_rows"] = "SELECT user_id, row_number() OVER w AS step, (floor(epoch(lead(ts) OVER w)) - floor(epoch(ts)))::BIGINT AS seconds, '{\"node\":\"' || event_type || '\",\"id\":' || event_id || '}' AS payload FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id, event_type)"


def flat_tables(spark, sf_dir):
    """Rows of each flat table that nested documents give, dangling groups included."""
    docs = _docs(spark, sf_dir, "session", "house", "question_id", "annexures_referenced")
    subs = _subs(spark, sf_dir, "doc_key", "sub_question_local", "part_label", "question_text", "question_language", "answer_group_id", "annexure_refs")
    groups = read_table(spark, sf_dir, "answer_groups").dropDuplicates(["answer_group_id"]).where(F.length("answer_group_id") % 5 > 0)
    table = F.struct(F.concat(F.col("answer_group_local"), F.lit("_t1")).alias("table_id"), F.array(F.struct(F.lit("r1").alias("row_id")), F.struct(F.lit("r2").alias("row_id"))).alias("rows"))
    made = nested.nest(docs, subs, groups, {"tables": F.when(F.col("answer_is_table"), F.array(table))})
    made = made.withColumn("annexures", F.transform("annexures_referenced", lambda x: F.struct(x.alias("ref_label")))).withColumn("diary_level_tables", F.array(F.struct(F.lit("d1").alias("table_id"), F.array(F.struct(F.lit("r1").alias("row_id"))).alias("rows"))))
    flat = nested.flatten(made.drop("annexures_referenced"))
    out = None
    for name, rows in flat.items():
        orphans = F.count_if("orphan") if "orphan" in rows.columns else F.lit(0).cast("bigint")
        one = rows.agg(F.count("*").alias("n"), orphans.alias("orphans"), F.count_distinct("doc_key").alias("documents")).select(F.lit(name).alias("name"), "n", "orphans", "documents")
        out = one if out is None else out.unionByName(one)
    return out


_G = "(SELECT DISTINCT answer_group_id, doc_key, answer_is_table FROM answer_groups WHERE length(answer_group_id) % 5 > 0 AND doc_key IN (SELECT doc_key FROM parsed))"
_S = "(SELECT DISTINCT sub_question_id, doc_key, answer_group_id FROM sub_questions WHERE doc_key IN (SELECT doc_key FROM parsed))"
_O = f"(SELECT DISTINCT doc_key, answer_group_id FROM {_S} WHERE answer_group_id IS NOT NULL AND answer_group_id NOT IN (SELECT answer_group_id FROM {_G}))"
SQL["flat_tables"] = f"""SELECT 'diaries' AS name, count(DISTINCT doc_key) AS n, 0::BIGINT AS orphans, count(DISTINCT doc_key) AS documents FROM parsed
 UNION ALL SELECT 'sub_questions', count(*), 0, count(DISTINCT doc_key) FROM {_S}
 UNION ALL SELECT 'answer_groups', count(*), sum(o)::BIGINT, count(DISTINCT doc_key) FROM (SELECT doc_key, 0 AS o FROM {_G} UNION ALL SELECT doc_key, 1 FROM {_O})
 UNION ALL SELECT 'answer_tables', count(*), 0, count(DISTINCT doc_key) FROM {_G} WHERE answer_is_table UNION ALL SELECT 'answer_table_rows', 2 * count(*), 0, count(DISTINCT doc_key) FROM {_G} WHERE answer_is_table
 UNION ALL SELECT 'diary_level_tables', count(DISTINCT doc_key), 0, count(DISTINCT doc_key) FROM parsed UNION ALL SELECT 'diary_level_table_rows', count(DISTINCT doc_key), 0, count(DISTINCT doc_key) FROM parsed
 UNION ALL SELECT 'annexures', count(*), 0, count(DISTINCT doc_key) FROM (SELECT doc_key, unnest(a) AS x FROM (SELECT doc_key, any_value(annexures_referenced) AS a FROM parsed GROUP BY 1))"""


def restored_documents(spark, sf_dir):
    """Stored documents that the tables lack: those of sessions that were loaded are left alone."""
    stored = _docs(spark, sf_dir, "session", "house", "question_id").select(F.to_json(F.struct("session", "house", "question_id")).alias("value"))
    docs = nested.from_lines(stored, "value")
    loaded = _docs(spark, sf_dir, "session").where("session >= '2020'")
    return docs.join(loaded.select("doc_key"), "doc_key", "left_anti").groupBy("session").agg(F.count("*").alias("documents"))


SQL["restored_documents"] = "SELECT session, count(DISTINCT doc_key) AS documents FROM parsed WHERE NOT session >= '2020' GROUP BY 1"


def vocabulary_hits(spark, sf_dir):
    """Parts of names of more than one word found in subjects: the longest that no other hit holds."""
    names = _docs(spark, sf_dir, "subject").select(F.explode(F.regexp_extract_all("subject", F.lit("([A-Z][a-z]+(?: [A-Z][a-z]+)?)"), 1)).alias("name")).select(F.lower("name").alias("name")).distinct()
    return dictionary.longest_hits(_docs(spark, sf_dir, "subject"), "doc_key", "subject", names, "name").select("doc_key", F.col("hit").alias("name"))


SQL["vocabulary_hits"] = "WITH d AS (SELECT DISTINCT doc_key, lower(subject) AS s, subject FROM parsed), n AS (SELECT DISTINCT lower(unnest(regexp_extract_all(subject, '([A-Z][a-z]+(?: [A-Z][a-z]+)?)', 1))) AS name FROM d), h AS (SELECT DISTINCT doc_key, name FROM d JOIN n ON contains(' ' || trim(regexp_replace(regexp_replace(s, '[^a-z0-9-]+', ' ', 'g'), '\\s+', ' ', 'g')) || ' ', ' ' || name || ' ')) SELECT doc_key, name FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE a.doc_key = b.doc_key AND b.name <> a.name AND contains(b.name, a.name))"


def entity_rules(spark, sf_dir):
    """Entities as several loads leave them: the best confidence ever given, a review only if all ask for one, the first claimant's name."""
    rows = read_table(spark, sf_dir, "sub_questions").select(F.col("answer_group_id").alias("entity"), F.col("sub_question_id").alias("name"), "confidence", F.col("confidence").isNull().alias("review")).where("entity IS NOT NULL").distinct()
    return dictionary.settle(rows, "entity", "name", "confidence", "review")


SQL["entity_rules"] = "SELECT answer_group_id AS entity, min(sub_question_id) AS name, CASE max(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' END AS confidence, bool_and(confidence IS NULL) AS review FROM sub_questions WHERE answer_group_id IS NOT NULL GROUP BY 1"


def kept_names(spark, sf_dir):
    """Subjects with synonyms in, but not inside the names of two projects' phrases."""
    return _docs(spark, sf_dir, "subject").where("subject IS NOT NULL").select("doc_key", T.apply_synonyms(F.lower("subject"), {"power": "energy", "supply": "delivery"}, ("hydro power", "power supply")).alias("ask"))


SQL["kept_names"] = "SELECT doc_key, replace(replace(regexp_replace(regexp_replace(replace(replace(lower(subject), 'power supply', '#1#'), 'hydro power', '#2#'), '\\bpower\\b', 'energy', 'g'), '\\bsupply\\b', 'delivery', 'g'), '#1#', 'power supply'), '#2#', 'hydro power') AS ask FROM (SELECT DISTINCT doc_key, subject FROM parsed WHERE subject IS NOT NULL)"


def table_keys(spark, sf_dir):
    """Tables numbered within their document, and their columns within them."""
    cols = read_table(spark, sf_dir, "table_columns").select("column_id", "table_id", "doc_key", "column_index").dropDuplicates(["column_id"])
    tables = cols.select("doc_key", "table_id").distinct().withColumn("t", F.row_number().over(Window.partitionBy("doc_key").orderBy("table_id")))  # a row a table
    n = F.row_number().over(Window.partitionBy("table_id").orderBy("column_index", "column_id"))
    return cols.join(tables, ["doc_key", "table_id"]).select("column_id", F.concat_ws("_", F.regexp_replace("doc_key", "/", "."), F.concat(F.lit("t"), F.col("t")), F.concat(F.lit("c"), n)).alias("key"))


SQL["table_keys"] = "WITH c AS (SELECT DISTINCT column_id, table_id, doc_key, column_index FROM table_columns), t AS (SELECT doc_key, table_id, row_number() OVER (PARTITION BY doc_key ORDER BY table_id) AS t FROM (SELECT DISTINCT doc_key, table_id FROM c)) SELECT column_id, replace(doc_key, '/', '.') || '_t' || t || '_c' || row_number() OVER (PARTITION BY c.table_id ORDER BY column_index, column_id) AS key FROM c JOIN t USING (doc_key, table_id)"


def dates_backfilled(spark, sf_dir):
    """Reply dates that are missing, from the subject, else the file's time; dates that are there stay."""
    rows = _docs(spark, sf_dir, "reply_date", "subject", "file_metadata")
    found = F.coalesce(T.parse_date(F.regexp_extract("subject", r"(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})", 1)), F.to_date(F.col("file_metadata.last_modified")))
    return rows.select("doc_key", F.coalesce(F.try_to_date("reply_date"), found).alias("reply_date"), F.col("reply_date").isNull().alias("filled"))


SQL["dates_backfilled"] = "SELECT doc_key, coalesce(try_cast(reply_date AS DATE), try_strptime(regexp_extract(subject, '(\\d{1,2}[./-]\\d{1,2}[./-]\\d{4})', 1), '%d.%m.%Y')::DATE, m::DATE) AS reply_date, reply_date IS NULL AS filled FROM (SELECT DISTINCT doc_key, reply_date, subject, file_metadata.last_modified AS m FROM parsed)"


def evidence(spark, sf_dir):
    """What a draft may quote: of the first forty sub-questions by id, those with an answer."""
    first = _subs(spark, sf_dir, "doc_key", "answer_text").orderBy("sub_question_id").limit(40)
    return first.where(F.coalesce(F.trim("answer_text"), F.lit("")) != "").select("sub_question_id", F.length("answer_text").alias("chars"))


SQL["evidence"] = "SELECT sub_question_id, length(answer_text) AS chars FROM (SELECT DISTINCT sub_question_id, answer_text FROM sub_questions ORDER BY 1 LIMIT 40) WHERE coalesce(trim(answer_text), '') <> ''"


def path_categories(spark, sf_dir):
    """The known category that a file's path names below its root; NULL for others."""
    known = _docs(spark, sf_dir, "house").select(F.col("house").alias("category")).distinct()
    rows = _docs(spark, sf_dir, "file_metadata").select("doc_key", F.lower(F.get(F.split(F.col("file_metadata.relative_path"), "/"), F.lit(1))).alias("category"))
    return rows.join(known.withColumn("known", F.lit(True)), "category", "left").select("doc_key", F.when(F.col("known"), F.col("category")).alias("category"))


SQL["path_categories"] = "SELECT doc_key, CASE WHEN c IN (SELECT house FROM parsed WHERE house IS NOT NULL) THEN c END AS category FROM (SELECT DISTINCT doc_key, lower(string_split(file_metadata.relative_path, '/')[2]) AS c FROM parsed)"


def repaired_spans(spark, sf_dir):
    """Spans of list items within their page's lines: put in range and order, and cut where the next one begins."""
    blocks = read_table(spark, sf_dir, "blocks").select("block_id", "doc_key", "page", "seq", "kind").dropDuplicates(["block_id"])
    lines = blocks.groupBy("doc_key", "page").agg(F.min("seq").alias("least"), F.max("seq").alias("most"))
    spans = blocks.where("kind = 'list_item'").select("doc_key", "page", (F.col("seq") - F.col("block_id") % 2).cast("int").alias("first"), (F.col("seq") + F.col("block_id") % 4).cast("int").alias("last"), "block_id").join(lines, ["doc_key", "page"])
    return crawl.repair_spans(spans, ["doc_key", "page"], "least", "most", "block_id").select("block_id", "first", "last")


SQL["repaired_spans"] = "WITH b AS (SELECT DISTINCT block_id, doc_key, page, seq, kind FROM blocks), l AS (SELECT doc_key, page, min(seq) AS least, max(seq) AS most FROM b GROUP BY 1, 2), s AS (SELECT block_id, b.doc_key, b.page, greatest(least, seq - block_id % 2)::INT AS f, least(most, seq + block_id % 4)::INT AS t FROM b JOIN l ON b.doc_key = l.doc_key AND b.page = l.page WHERE kind = 'list_item') SELECT block_id, f AS first, greatest(f, least(t, coalesce(lead(f) OVER (PARTITION BY doc_key, page ORDER BY f, t, block_id) - 1, t)))::INT AS last FROM s"


def queries():
    return {name: globals()[name] for name in SQL}


def oracle_sql():
    return SQL
