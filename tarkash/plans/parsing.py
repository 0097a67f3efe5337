"""Queries of answers found in replies, readings of tables, names, loose files and captured results, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarkash.functions.replies import ANSWER_MARK
from tarkash.functions.text import collapse
from tarkash.operators import dictionary, files, grids, segments
from tarkash.plans.texts import NORMAL, SLUG
from tarkash.sources import read_table

SQL: dict[str, str] = {}
COLLAPSED = "trim(regexp_replace({0}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


def _subs(spark, sf_dir, *columns):
    return read_table(spark, sf_dir, "sub_questions").select("sub_question_id", *columns).dropDuplicates(["sub_question_id"])


def _groups(spark, sf_dir, *columns):
    return read_table(spark, sf_dir, "answer_groups").select("answer_group_id", *columns).dropDuplicates(["answer_group_id"])


def reply_answers(spark, sf_dir):
    """Answers of replies in which each pair stands twice, under two labels and two marks."""
    rows = _subs(spark, sf_dir, "question_text", "answer_text").where("question_text IS NOT NULL AND answer_text IS NOT NULL")
    reply = F.concat(F.lit("(a) "), "question_text", F.lit(" Comment: "), "answer_text", F.lit(" (B) "), "question_text", F.lit(" Reply: "), "answer_text")
    return rows.select("sub_question_id", F.posexplode(segments.answers_of(reply)).alias("n", "answer"))


LABELS = "regexp_extract_all(lower({0}), '\\(\\s*([a-z])\\s*\\)', 1)"
SQL["reply_answers"] = f"""WITH RECURSIVE s AS (SELECT sub_question_id, string_split_regex('(a) ' || question_text || ' Comment: ' || answer_text || ' (B) ' || question_text || ' Reply: ' || answer_text, '{ANSWER_MARK}') AS p FROM (SELECT DISTINCT sub_question_id, question_text, answer_text FROM sub_questions)),
f AS (SELECT sub_question_id, p, 1 AS i, list_reduce({LABELS.format('p[1]')}, lambda d, x: CASE WHEN x = d OR d = '' AND x IN ('a', 'b') THEN chr(ascii(x) + 1) ELSE d END, '') AS due, '' AS answer FROM s WHERE p IS NOT NULL
UNION ALL SELECT sub_question_id, p, i + 1, CASE WHEN mark = '' THEN due ELSE list_reduce({LABELS.format("substring(t, length(first) + length(mark) + 1)")}, lambda d, x: CASE WHEN x = d THEN chr(ascii(x) + 1) ELSE d END, chr(ascii(due) + 1)) END, {COLLAPSED.format('first')}
 FROM (SELECT *, CASE WHEN mark = '' THEN t ELSE left(t, strpos(t, mark) - 1) END AS first FROM (SELECT *, p[i + 1] AS t, CASE WHEN due = '' THEN '' ELSE regexp_extract(p[i + 1], '(?i)\\(\\s*' || due || '\\s*\\)') END AS mark FROM f WHERE i < len(p))))
SELECT sub_question_id, (row_number() OVER (PARTITION BY sub_question_id ORDER BY i) - 1)::INT AS n, answer FROM f WHERE answer <> ''"""


def recovered_answers(spark, sf_dir):
    """Blank answers found again in a source that repeats the question, with what its group is known to be."""
    rows = _subs(spark, sf_dir, "answer_group_id", "question_text", "answer_text").where("question_text IS NOT NULL AND (answer_text IS NULL OR trim(answer_text) = '')")
    kinds = _groups(spark, sf_dir, "answer_type")
    source = F.concat(F.lit("As below:\n(a) "), F.upper("question_text"), F.lit("  Reply:\n "), F.coalesce("answer_type", F.lit("")), F.lit(" on  record (b) more to come"))
    return rows.join(kinds, "answer_group_id", "left").select("sub_question_id", segments.recovered(F.col("question_text"), source).alias("answer"))


NEEDLE = f"left(lower({COLLAPSED.format("regexp_replace(question_text, '^\\s*\\([a-z0-9]+\\)\\s*', '')")}), 40)"
SQL["recovered_answers"] = f"""WITH g AS (SELECT DISTINCT answer_group_id, answer_type FROM answer_groups), s AS (SELECT sub_question_id, {NEEDLE} AS needle, {COLLAPSED.format("'As below:\n(a) ' || upper(question_text) || '  Reply:\n ' || coalesce(answer_type, '') || ' on  record (b) more to come'")} AS plain FROM (SELECT DISTINCT sub_question_id, answer_group_id, question_text, answer_text FROM sub_questions) q LEFT JOIN g USING (answer_group_id) WHERE question_text IS NOT NULL AND (answer_text IS NULL OR trim(answer_text) = '')),
a AS (SELECT sub_question_id, CASE WHEN needle <> '' AND strpos(lower(plain), needle) > 0 THEN regexp_extract(substring(plain, strpos(lower(plain), needle)), '(?is)\\b(?:comment|answer|reply)\\b\\s*[:.-](.*)$', 1) END AS answer FROM s)
SELECT sub_question_id, coalesce(nullif(trim(regexp_replace(answer, '\\s*\\([a-z]\\)\\s.*$', '')), ''), nullif(trim(answer), '')) AS answer FROM a"""


def picked_answers(spark, sf_dir):
    """Of its group's parts the one at the place of each sub-question's letter; empty where there is none."""
    rows = _subs(spark, sf_dir, "answer_group_id", "part_label")
    parts = _groups(spark, sf_dir, "answers_parts")
    return rows.join(parts, "answer_group_id", "left").select("sub_question_id", F.coalesce(F.get("answers_parts", F.ascii("part_label") - 97), F.lit("")).alias("part"))


SQL["picked_answers"] = "SELECT sub_question_id, coalesce(answers_parts[ascii(part_label) - 96], '') AS part FROM (SELECT DISTINCT sub_question_id, answer_group_id, part_label FROM sub_questions) LEFT JOIN (SELECT DISTINCT answer_group_id, answers_parts FROM answer_groups) USING (answer_group_id)"


def mined_abbreviations(spark, sf_dir):
    """Abbreviations that subjects explain: their words with capitals, and the initials of the last four in brackets."""
    words = F.transform(F.regexp_extract_all("subject", F.lit("([A-Za-z]{2,})"), 1), F.initcap)
    rows = read_table(spark, sf_dir, "parsed").select("doc_key", "subject").dropDuplicates(["doc_key"]).select(words.alias("w")).where("size(w) > 3")
    short = F.array_join(F.transform(F.slice("w", -4, 4), lambda x: F.substring(x, 1, 1)), "")
    return dictionary.abbreviations(rows.select(F.concat(F.array_join("w", " "), F.lit(" ("), short, F.lit(") is asked about")).alias("text")), "text")


SQL["mined_abbreviations"] = "WITH d AS (SELECT DISTINCT doc_key, list_transform(regexp_extract_all(subject, '[A-Za-z]{2,}'), lambda x: upper(x[1]) || lower(x[2:])) AS w FROM parsed WHERE subject IS NOT NULL), l AS (SELECT w[len(w) - 3:] AS w FROM d WHERE len(w) > 3) SELECT array_to_string(list_transform(w, lambda x: x[1]), '') AS abbreviation, array_to_string(w, ' ') AS \"full\", count(*) AS n FROM l GROUP BY 1, 2"


def headed_blocks(spark, sf_dir):
    """Headed blocks of long answers that give the question and the reply under headings of their own."""
    rows = _subs(spark, sf_dir, "question_text", "answer_text").where("question_text IS NOT NULL AND answer_text IS NOT NULL")
    text = F.concat(F.lit("What was asked:\n"), "question_text", F.lit("\nWhat is replied:\n"), "answer_text")
    return rows.select("sub_question_id", F.posexplode(segments.blocks(text)).alias("n", "b")).select("sub_question_id", "n", "b.heading", "b.text")


SQL["headed_blocks"] = f"""WITH s AS (SELECT DISTINCT sub_question_id, question_text AS q, answer_text AS a FROM sub_questions WHERE length(question_text) + length(answer_text) + 34 >= 300)
SELECT sub_question_id, 0 AS n, 'What was asked' AS heading, {COLLAPSED.format('q')} AS text FROM s UNION ALL SELECT sub_question_id, 1, 'What is replied', {COLLAPSED.format('a')} FROM s"""


def richer_readings(spark, sf_dir):
    """Of two readings of each header cell, one with its name over two rows and one flat, the richer one, rendered."""
    rows = read_table(spark, sf_dir, "table_columns").select("column_id", "name", "role", "language").dropDuplicates(["column_id"])
    text = lambda c: collapse(F.coalesce(c, F.lit("")))
    cell = lambda r0, r1, c0, c1, t: F.struct(*[F.lit(v).alias(n) for v, n in ((r0, "r0"), (r1, "r1"), (c0, "c0"), (c1, "c1"))], t.alias("text"))
    merged = grids.expand_merged(F.array(cell(0, 2, 0, 1, text("name")), cell(0, 1, 1, 2, text("role")), cell(1, 2, 1, 2, text("language"))), F.lit(2), F.lit(2))
    flat = F.array(F.array(text("name"), text("role"), text("language")))
    best = F.when(grids.richness(merged) >= grids.richness(flat), merged).otherwise(flat)
    wide = F.when(F.length(text("role")) > 5, merged).otherwise(best)
    line = lambda g: F.array_join(F.transform(g, lambda r: F.array_join(r, "|")), "/")
    return rows.select("column_id", line(best).alias("best"), line(wide).alias("wide"), grids.richness(merged)["filled"].alias("filled"))


_T = {c: COLLAPSED.format(f"coalesce({c}, '')") for c in ("name", "role", "language")}
SQL["richer_readings"] = f"""WITH t AS (SELECT DISTINCT column_id, {_T['name']} AS n, {_T['role']} AS r, {_T['language']} AS l FROM table_columns)
SELECT column_id, n || '|' || r || '|' || l AS best, CASE WHEN length(r) > 5 THEN n || '|' || r || '/' || n || '|' || l ELSE n || '|' || r || '|' || l END AS wide, (2 * (n <> '')::INT + (r <> '')::INT + (l <> '')::INT)::INT AS filled FROM t"""


def loose_files(spark, sf_dir):
    """Files in folders of documents without any letter or report on record."""
    listed = read_table(spark, sf_dir, "parsed").select("doc_key", F.col("file_metadata.relative_path").alias("path")).where("path IS NOT NULL").distinct()
    known = read_table(spark, sf_dir, "documents").where("doc_key IS NOT NULL").select(F.col("doc_key").alias("folder"))
    return files.unclaimed(listed.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder")), known, "folder").select("path", "folder")


SQL["loose_files"] = "SELECT DISTINCT path, folder FROM (SELECT file_metadata.relative_path AS path, regexp_replace(file_metadata.relative_path, '/[^/]*$', '') AS folder FROM parsed) WHERE path IS NOT NULL AND folder NOT IN (SELECT doc_key FROM documents WHERE doc_key IS NOT NULL)"


def seeded_states(spark, sf_dir):
    """Entities and aliases of the states that documents name."""
    return dictionary.seeds(read_table(spark, sf_dir, "parsed"), "state", "state")


SQL["seeded_states"] = f"SELECT arg_min({SLUG.format('state')}, (state, {SLUG.format('state')})) AS entity_id, 'state' AS kind, {NORMAL.format('state')} AS alias FROM (SELECT DISTINCT state FROM parsed WHERE trim(state) <> '') GROUP BY 3"


def captured_results(spark, sf_dir):
    """Each sub-question as the slim line of JSON that an evaluation run records."""
    rows = _subs(spark, sf_dir, "doc_key", "question_text", "answer_text", "embedding")
    slim = F.struct(F.col("sub_question_id").alias("id"), F.coalesce("doc_key", F.lit("")).alias("doc"), F.substring(F.coalesce("question_text", F.lit("")), 1, 120).alias("question"), (F.length(F.trim(F.coalesce("answer_text", F.lit("")))) > 0).alias("answered"), F.coalesce(F.array_size("embedding"), F.lit(0)).alias("dimensions"))
    return rows.select("sub_question_id", F.to_json(slim).alias("line"))


SQL["captured_results"] = "SELECT sub_question_id, to_json({'id': sub_question_id, 'doc': coalesce(doc_key, ''), 'question': left(coalesce(question_text, ''), 120), 'answered': length(trim(coalesce(answer_text, ''))) > 0, 'dimensions': coalesce(len(embedding), 0)})::VARCHAR AS line FROM (SELECT DISTINCT sub_question_id, doc_key, question_text, answer_text, embedding FROM sub_questions)"


def queries():
    return {name: globals()[name] for name in SQL}


def oracle_sql():
    return SQL
