"""Queries of dictionaries, grids, nested documents and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarkash.operators import dictionary, files, grids, segments
from tarkash.sources import documents as nested
from tarkash.sources import read_table
from tarkash.streaming import events as streams

SQL: dict[str, str] = {}
PLACE = r"(?:in|at|below|near|to|of) ([A-Z][a-z]+(?:[ -][A-Z][A-Za-z]*)*)"


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "parsed").dropDuplicates(["doc_key"])


def _subs(spark, sf_dir):
    return read_table(spark, sf_dir, "sub_questions").dropDuplicates(["sub_question_id"])


def _dictionary(spark, sf_dir):
    names = _docs(spark, sf_dir).select("doc_key", F.regexp_extract("subject", PLACE, 1).alias("name")).where("name <> ''")
    return dictionary.build(names, "name", "place", F.col("doc_key"))


DICTIONARY = f"(SELECT lower(name) AS alias, regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g') AS entity_id FROM (SELECT DISTINCT regexp_extract(subject, '{PLACE}', 1) AS name FROM parsed) WHERE name <> '')"
SUBS = "(SELECT DISTINCT sub_question_id, doc_key, sub_question_local, question_text, answer_text FROM sub_questions)"


def _words(column: str) -> str:
    return f"regexp_extract_all(regexp_replace(lower({column}), '[.–—_/]+', ' ', 'g'), '[\\p{{L}}\\p{{M}}\\p{{N}}&''-]+')"


def entity_links(spark, sf_dir):
    """Places of the subjects found in questions and answers."""
    words, subs = _dictionary(spark, sf_dir), _subs(spark, sf_dir)
    q = dictionary.match(subs, "sub_question_id", "question_text", words)
    a = dictionary.match(subs, "sub_question_id", "answer_text", words)
    return dictionary.links(q, a, "sub_question_id")


# The SQL drops matches that overlap a longer one; the operator's greedy choice is the same where no chain of three overlaps.
SQL["entity_links"] = f"WITH d AS {DICTIONARY}, w AS (SELECT sub_question_id, {_words('question_text')} AS w, 'question' AS s FROM {SUBS} UNION ALL SELECT sub_question_id, {_words('answer_text')}, 'answer' FROM {SUBS}), r AS (SELECT sub_question_id, s, w, unnest(range(1, len(w) + 1)) AS i FROM w), g AS (SELECT sub_question_id, s, i, n, array_to_string(w[i:i + n - 1], ' ') AS alias FROM r, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE i + n - 1 <= len(w)), h AS (SELECT g.*, entity_id, length(alias) AS size FROM g JOIN d USING (alias)), k AS (SELECT * FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE a.sub_question_id = b.sub_question_id AND a.s = b.s AND b.i < a.i + a.n AND a.i < b.i + b.n AND (b.size > a.size OR b.size = a.size AND b.i < a.i))) SELECT sub_question_id, entity_id, CASE WHEN count(DISTINCT s) > 1 THEN 'both' ELSE min(s) END AS provenance FROM k GROUP BY 1, 2"


def dictionary_stats(spark, sf_dir):
    words = _dictionary(spark, sf_dir)
    return words.groupBy("kind").agg(F.count("*").alias("aliases"), F.count_distinct("entity_id").alias("entities"), F.max(F.length("alias")).alias("longest"))


SQL["dictionary_stats"] = f"SELECT 'place' AS kind, count(*) AS aliases, count(DISTINCT entity_id) AS entities, max(length(alias)) AS longest FROM {DICTIONARY}"


def entity_merge(spark, sf_dir):
    """Links of each place moved to the least place of its first three letters, each once a document."""
    docs = _docs(spark, sf_dir).select("doc_key", F.lower(F.regexp_extract("subject", PLACE, 1)).alias("entity_id")).where("entity_id <> ''")
    first = docs.groupBy(F.substring("entity_id", 1, 3).alias("p")).agg(F.min("entity_id").alias("survivor"))
    merges = docs.select("entity_id").distinct().join(first, F.substring("entity_id", 1, 3) == F.col("p")).select("entity_id", "survivor")
    return dictionary.repoint(docs, merges).groupBy("entity_id").agg(F.count("*").alias("documents"))


SQL["entity_merge"] = f"WITH d AS (SELECT DISTINCT doc_key, lower(regexp_extract(subject, '{PLACE}', 1)) AS e FROM parsed), m AS (SELECT left(e, 3) AS p, min(e) AS s FROM d WHERE e <> '' GROUP BY 1) SELECT s AS entity_id, count(DISTINCT doc_key) AS documents FROM d JOIN m ON left(e, 3) = p WHERE e <> '' GROUP BY 1"


def grid_stitch(spark, sf_dir):
    """Each order's lines as a grid whose even rows are wrapped ones (first cell blank), stitched and rendered."""
    lines = read_table(spark, sf_dir, "lineitem")
    row = F.array(F.when(F.col("l_linenumber") % 2 == 1, F.col("l_linenumber").cast("string")).otherwise(""), F.col("l_returnflag"), F.concat(F.lit(" "), F.col("l_linestatus"), F.lit("  ")))
    made = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("row")))).alias("r"))
    body = grids.stitch_wrapped(grids.drop_legends(grids.drop_empty_rows(grids.clean_cells(F.transform("r", lambda x: x["row"])))))
    done = grids.render(F.concat(F.array(F.array(F.lit("no"), F.lit("flag"), F.lit("status"))), body))
    return made.select("l_orderkey", F.array_join(done, " | ").alias("lines"))


SQL["grid_stitch"] = "WITH l AS (SELECT *, sum(l_linenumber % 2) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus ROWS UNBOUNDED PRECEDING) AS k FROM lineitem), g AS (SELECT l_orderkey, k, CASE WHEN k > 0 THEN 'no: ' || min(l_linenumber) || '; ' ELSE '' END AS n, string_agg(l_returnflag, ' ' ORDER BY l_linenumber, l_returnflag, l_linestatus) AS f, string_agg(l_linestatus, ' ' ORDER BY l_linenumber, l_returnflag, l_linestatus) AS s FROM l GROUP BY 1, 2) SELECT l_orderkey, string_agg(n || 'flag: ' || f || '; status: ' || s, ' | ' ORDER BY k) AS lines FROM g GROUP BY 1"


def nested_round_trip(spark, sf_dir):
    """Sub-questions nested into their documents and flattened again."""
    groups = read_table(spark, sf_dir, "answer_groups").dropDuplicates(["answer_group_id"])
    docs = nested.nest(_docs(spark, sf_dir).select("doc_key", "session", "house", "question_id"), _subs(spark, sf_dir), groups)
    key = F.concat_ws("#", "doc_key", "sub_question_id")
    flat = docs.select("doc_key", F.inline("sub_questions"))
    return flat.select(key.alias("sub_question_id"), "part_label", F.concat_ws("#", "doc_key", "answer_group_id").alias("answer_group_id"), F.size("annexure_refs").alias("refs"))


SQL["nested_round_trip"] = "SELECT DISTINCT sub_question_id, part_label, answer_group_id, len(annexure_refs) AS refs FROM sub_questions"


def reply_parts(spark, sf_dir):
    """Parts of each answer at its markers, answers of blank parts taken from the part after."""
    rows = _subs(spark, sf_dir).where("answer_text IS NOT NULL")
    made = rows.select("sub_question_id", segments.parts(F.col("answer_text")).alias("p")).select("sub_question_id", F.posexplode(segments.with_shared(F.col("p"))).alias("n", "part"))
    return made.select("sub_question_id", "n", F.col("part.label").alias("label"), F.col("part.body").alias("body"))


MARK = r"\(\s*(?:[a-z]|[ivx]{1,4})\s*\)"
BLANK = "regexp_replace(body, '[ \\t\\n\\x0B\\f\\r,&]|and|to', '', 'g') = ''"
SQL["reply_parts"] = f"""WITH p AS (SELECT sub_question_id, regexp_extract_all(answer_text, '\\(\\s*([a-z]|[ivx]{{1,4}})\\s*\\)', 1) AS m, string_split_regex(answer_text, '{MARK}') AS b FROM (SELECT DISTINCT sub_question_id, answer_text FROM sub_questions WHERE answer_text IS NOT NULL)),
r AS (SELECT sub_question_id, i, CASE WHEN i > 1 THEN m[i - 1] END AS label, trim(regexp_replace(b[i], '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS body FROM (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM p)), k AS (SELECT * FROM r WHERE label IS NOT NULL OR body <> '')
SELECT sub_question_id, (row_number() OVER w - 1)::INT AS n, label, coalesce(first_value(CASE WHEN NOT {BLANK} THEN body END IGNORE NULLS) OVER (PARTITION BY sub_question_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), body) AS body FROM k WINDOW w AS (PARTITION BY sub_question_id ORDER BY i)"""


def shared_parts(spark, sf_dir):
    """Parts of a document numbered by the answer whose wording they share."""
    parts = _subs(spark, sf_dir).select("doc_key", F.col("sub_question_id").alias("label"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), F.col("answer_text").alias("body"))
    return segments.shared_groups(parts, "doc_key").select("doc_key", F.col("label").alias("sub_question_id"), "answer_group")


SQL["shared_parts"] = f"WITH s AS (SELECT doc_key, sub_question_id, coalesce(nullif(lower(trim(regexp_replace(answer_text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))), ''), chr(0) || sub_question_id) AS same FROM {SUBS}), l AS (SELECT *, min(sub_question_id) OVER (PARTITION BY doc_key, same) AS least FROM s) SELECT doc_key, sub_question_id, dense_rank() OVER (PARTITION BY doc_key ORDER BY least, same) AS answer_group FROM l"


def span_errors(spark, sf_dir):
    """Text between headings as spans of a document's blocks, checked for range, order and overlap."""
    blocks = read_table(spark, sf_dir, "blocks").dropDuplicates(["block_id"])
    lines = blocks.groupBy("doc_key").agg((F.count("*") - 1).cast("int").alias("lines"))
    spans = blocks.where("kind = 'list_item'").select("doc_key", F.col("seq").alias("first"), (F.col("seq") + F.col("page") % 3).alias("last"), F.col("page").cast("string").alias("label")).join(lines, "doc_key")
    done = segments.verify_spans(spans, "doc_key", "lines")
    return done.select("doc_key", "first", "last", F.array_join("errors", ";").alias("errors")).where("errors <> ''")


SQL["span_errors"] = "WITH b AS (SELECT DISTINCT block_id, doc_key, page, seq, kind FROM blocks), n AS (SELECT doc_key, count(*) - 1 AS lines FROM b GROUP BY 1), s AS (SELECT b.doc_key, seq AS first, seq + page % 3 AS last, page::VARCHAR AS label, lines FROM b JOIN n USING (doc_key) WHERE kind = 'list_item'), e AS (SELECT doc_key, first, last, concat_ws(';', CASE WHEN first < 1 OR last > lines THEN 'range' END, CASE WHEN last < first THEN 'reversed' END, CASE WHEN lag(last) OVER (PARTITION BY doc_key ORDER BY first, last, label) >= first THEN 'overlap' END, CASE WHEN row_number() OVER (PARTITION BY doc_key, label ORDER BY first, last) > 1 THEN 'label' END) AS errors FROM s) SELECT * FROM e WHERE errors <> ''"


def folder_merge(spark, sf_dir):
    """Documents that a bare question number makes one within a session, with all their flags."""
    docs = _docs(spark, sf_dir).select("session", files.question_id(F.regexp_replace("question_id", "^s-", "")).alias("number"), "extraction_flags")
    rows = files.merge_folders(docs, ["session", "number"], "extraction_flags")
    return rows.select("session", "number", "folders", F.array_join("flags", ";").alias("flags"), "review")


SQL["folder_merge"] = "WITH d AS (SELECT DISTINCT doc_key, session, CASE WHEN regexp_extract(question_id, '(\\d+)', 1) = '' THEN lower(question_id) ELSE regexp_extract(question_id, '(\\d+)', 1) END AS number, extraction_flags AS f FROM parsed), g AS (SELECT session, number, count(*) AS folders, list_sort(list_distinct(flatten(list(f)))) AS fl FROM d GROUP BY 1, 2) SELECT session, number, folders, array_to_string(fl, ';') AS flags, folders > 1 OR len(fl) > 0 AS review FROM g"


def latest_files(spark, sf_dir):
    """The best file of each session and house by name, time and kind."""
    rows = _docs(spark, sf_dir).select("session", "house", F.col("file_metadata.original_filename").alias("name"), F.col("file_metadata.last_modified").alias("modified"))
    return files.latest(rows, ["session", "house"], "name", "modified").select("session", "house", "name", "score", "ties")


_LOW = "lower(name)"
SQL["latest_files"] = f"""WITH f AS (SELECT *, CASE WHEN regexp_matches({_LOW}, '\\b(reply|answer|ans|response)\\b') THEN 3 ELSE 0 END - CASE WHEN regexp_matches({_LOW}, '\\b(covering\\s*letter|forwarding|note|briefing|minutes|agenda|index|email|corrigendum)\\b') THEN 3 ELSE 0 END + CASE WHEN regexp_matches({_LOW}, '\\bapproved\\b') THEN 40 WHEN regexp_matches({_LOW}, '\\bfinal\\b') THEN 30 WHEN regexp_matches({_LOW}, '\\brevised') THEN 20 WHEN regexp_matches({_LOW}, '\\bdraft\\b') THEN -10 ELSE 0 END AS score
 FROM (SELECT DISTINCT doc_key, session, house, file_metadata.original_filename AS name, file_metadata.last_modified AS m FROM parsed) WHERE NOT regexp_matches(name, '^(\\.|~\\$)|\\.(tmp|lnk|download|db|ini)$')),
 r AS (SELECT *, row_number() OVER (PARTITION BY session, house ORDER BY score DESC, coalesce(m, TIMESTAMP '1970-01-01') DESC, {_LOW} LIKE '%.pdf' DESC, name DESC) AS k, count(*) OVER (PARTITION BY session, house, score, m) - 1 AS ties FROM f)
 SELECT session, house, name, score, ties FROM r WHERE k = 1"""


def stream_sessions(spark, sf_dir):
    rows = streams.drain(streams.debounce(streams.read_events(spark, sf_dir), "6 hours"), streams.shared_folder(spark, "sessions"))
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "events", "last_kind")


SQL["stream_sessions"] = "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g) SELECT user_id, min(ts) AS start, count(*) AS events, arg_max(event_type, (ts, event_type)) AS last_kind FROM i GROUP BY user_id, island"


def stream_windows(spark, sf_dir):
    rows = streams.drain(streams.windowed(streams.read_events(spark, sf_dir), "12 hours", "6 hours", "1 hour"), streams.shared_folder(spark, "windows"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", "value")


SQL["stream_windows"] = "SELECT start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') - INTERVAL 6 HOUR]) AS start FROM events) GROUP BY 1, 2"


def queries():
    return {name: globals()[name] for name in SQL}


def oracle_sql():
    return SQL
