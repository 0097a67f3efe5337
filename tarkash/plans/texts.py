"""Queries of the text, date, label and path functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarkash.functions import text as T
from tarkash.sources import read_table

SQL: dict[str, str] = {}
TITLES = "(SELECT DISTINCT doc_key, subject FROM parsed)"
SUBS = "(SELECT DISTINCT sub_question_id, doc_key, question_text, answer_text FROM sub_questions)"
SYNONYMS = {"power supply": "electricity supply", "dam": "barrage", "floods": "inundation", "local jobs": "employment"}


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "parsed").dropDuplicates(["doc_key"])


def _subs(spark, sf_dir):
    return read_table(spark, sf_dir, "sub_questions").dropDuplicates(["sub_question_id"])


def normalise_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_key", T.normalise(F.col("subject")).alias("plain"), T.slug(F.col("subject")).alias("slug"))


NORMAL = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '&', ' and ', 'g'), '[.–—_/]+', ' ', 'g'), '\\s+', ' ', 'g'))"
SLUG = "CASE WHEN {0} IS NULL THEN NULL ELSE coalesce(nullif(regexp_replace(regexp_replace(" + NORMAL + ", '[^a-z0-9ऀ-ॿ]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'entity') END"
SQL["normalise_text"] = f"SELECT doc_key, {NORMAL.format('subject')} AS plain, {SLUG.format('subject')} AS slug FROM {TITLES}"


def language_tag(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", T.language_tag(F.col("text")).alias("tag"), T.has_devanagari(F.col("text")).alias("devanagari"))


SQL["language_tag"] = "SELECT doc_id, CASE WHEN d >= 3 AND l >= 3 THEN 'mixed' WHEN d > l THEN 'hi' ELSE 'en' END AS tag, d > 0 AS devanagari FROM (SELECT doc_id, length(regexp_replace(text, '[^ऀ-ॿ]', '', 'g')) AS d, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l FROM documents WHERE text IS NOT NULL)"


def filler_strip(spark, sf_dir):
    asked = F.concat(F.lit("Please provide the details of all "), F.lower("subject"))
    return _docs(spark, sf_dir).where("subject IS NOT NULL").select("doc_key", T.strip_filler(asked).alias("ask"))


SQL["filler_strip"] = f"SELECT doc_key, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(subject), '\\ball\\b\\s*', '', 'g'), '\\bthe\\b\\s*', '', 'g'), '\\ban\\b\\s*', '', 'g'), '\\ba\\b\\s*', '', 'g'), '\\s+', ' ', 'g'), ' ,.:;-') AS ask FROM {TITLES} WHERE subject IS NOT NULL"


def synonym_rewrite(spark, sf_dir):
    return _docs(spark, sf_dir).where("subject IS NOT NULL").select("doc_key", T.apply_synonyms(F.lower("subject"), SYNONYMS).alias("ask"))


def _synonyms(text: str) -> str:
    for phrase in sorted(SYNONYMS, key=lambda p: (-len(p), p)):
        text = f"regexp_replace({text}, '\\b{phrase}\\b', '{SYNONYMS[phrase]}', 'g')"
    return text


SQL["synonym_rewrite"] = f"SELECT doc_key, {_synonyms('lower(subject)')} AS ask FROM {TITLES} WHERE subject IS NOT NULL"


def merge_buckets(spark, sf_dir):
    """Parts whose names differ in order and generic words only: a survivor of most lines, then longest name."""
    parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", T.merge_key(F.col("p_name")).alias("bucket"))
    links = read_table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("links"))
    rows = parts.join(links, F.col("p_partkey") == F.col("l_partkey"), "left").withColumn("links", F.coalesce("links", F.lit(0)))
    return rows.where("bucket <> ''").groupBy("bucket").agg(F.max_by("p_partkey", F.struct("links", F.length("p_name"), (-F.col("p_partkey")).alias("k"))).alias("survivor"), F.count("*").alias("merged"))


GENERIC = ", ".join(f"'{w}'" for w in T.GENERIC_WORDS)
SQL["merge_buckets"] = f"WITH p AS (SELECT p_partkey, p_name, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(translate({NORMAL.format('p_name')}, '()', '  '), '\\s+'), lambda w: w <> '' AND w NOT IN ({GENERIC}) AND (NOT regexp_matches(w, '^[\\d,.]+$') OR regexp_matches(w, '^(19|20)\\d\\d$'))))), '|') AS bucket FROM part), l AS (SELECT l_partkey, count(*) AS links FROM lineitem GROUP BY 1) SELECT bucket, arg_max(p_partkey, (coalesce(links, 0), length(p_name), -p_partkey)) AS survivor, count(*) AS merged FROM p LEFT JOIN l ON p_partkey = l_partkey WHERE bucket <> '' GROUP BY 1"


def session_parts(spark, sf_dir):
    name = F.concat(F.lit("PARLIAMENT "), F.upper(F.regexp_replace(F.regexp_replace("session", r"^(\d{4})-", ""), "-", " ")), F.lit(" "), F.substring("session", 1, 4))
    rows = _docs(spark, sf_dir).select("session", "house").distinct()
    return rows.select("session", T.session_year(F.col("session")).alias("year"), T.session_slug(name).alias("slug"), T.house_of(F.initcap(F.regexp_replace("house", "_", " "))).alias("house"))


SQL["session_parts"] = "SELECT DISTINCT session, left(session, 4)::INT AS year, session AS slug, house FROM parsed"


def reply_dates(spark, sf_dir):
    """Reply dates read from the stored text, within a year of the session."""
    year = T.session_year(F.col("session"))
    return _docs(spark, sf_dir).select("doc_key", T.gate_date(T.parse_date(F.col("reply_date"), year), year).alias("reply_date"))


SQL["reply_dates"] = "SELECT doc_key, CASE WHEN abs(year(d) - left(session, 4)::INT) <= 1 AND year(d) BETWEEN 2000 AND 2050 THEN d END AS reply_date FROM (SELECT DISTINCT doc_key, session, try_cast(reply_date AS DATE) AS d FROM parsed)"


def dated_references(spark, sf_dir):
    """The first date that follows a date word in a document, with no session to check it against."""
    rows = read_table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", T.anchored_date(F.col("text"), F.lit(None).cast("int")).alias("first_date")).where("first_date IS NOT NULL")


def annexure_mentions(spark, sf_dir):
    rows = _subs(spark, sf_dir).withColumn("label", F.explode(T.annexure_labels(F.col("answer_text"))))
    return rows.select("sub_question_id", "label", T.label_number(F.substring("label", 10, 9)).alias("number"))


SQL["annexure_mentions"] = f"SELECT sub_question_id, label, CASE WHEN regexp_matches(l, '^\\d+$') THEN l::INT WHEN list_position(['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI','XVII','XVIII','XIX','XX'], l) > 0 THEN list_position(['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI','XVII','XVIII','XIX','XX'], l) WHEN regexp_matches(l, '^[A-Z]$') THEN ascii(l) - 64 END AS number FROM (SELECT DISTINCT sub_question_id, 'Annexure-' || upper(x) AS label, upper(x) AS l FROM (SELECT sub_question_id, unnest(regexp_extract_all(answer_text, '(?i)annex(?:ure)?\\.?\\s*[-\\s]?\\s*([IVXLC]+|\\d+|[A-H])\\b', 1)) AS x FROM {SUBS}))"


def answer_types(spark, sf_dir):
    return _subs(spark, sf_dir).select("sub_question_id", T.answer_type(F.col("answer_text")).alias("made"))


SQL["answer_types"] = f"""SELECT sub_question_id, CASE WHEN coalesce(trim(answer_text, ' '), '') = '' THEN 'substantive'
 WHEN regexp_matches(answer_text, '(?i)does\\s+not\\s+(pertain|concern|relate)\\s*(to)?\\s+(this|the)\\s+(company|undertaking|corporation)|not\\s+(applicable|related)\\s+to\\s+(this|the)\\s+(company|undertaking)') THEN 'not_applicable'
 WHEN regexp_matches(answer_text, '(?i)treated\\s+as\\s+nil|information.*nil|^\\s*nil\\b|\\bnil\\b\\s*$|no\\s+such\\s+(instances?|proposal)') THEN 'nil'
 WHEN length(regexp_replace(answer_text, '\\s+', '', 'g')) < 120 AND regexp_matches(answer_text, '(?i)may\\s+be\\s+(replied|given)\\s+by|pertains?\\s+to\\s+(the\\s+)?(ministry|state)|to\\s+be\\s+replied\\s+by') THEN 'deferred_to_ministry' ELSE 'substantive' END AS made FROM {SUBS}"""


def column_roles(spark, sf_dir):
    cols = read_table(spark, sf_dir, "table_columns").dropDuplicates(["column_id"])
    return cols.select("column_id", T.collapse(F.col("name")).alias("clean"), T.column_role(F.col("name")).alias("made"))


CLEAN = "trim(regexp_replace(name, '\\s+', ' ', 'g'))"
SQL["column_roles"] = f"SELECT column_id, {CLEAN} AS clean, CASE " + " ".join(f"WHEN regexp_matches({CLEAN}, '(?i){p}') THEN '{r}'" for r, p in T.ROLES) + " ELSE 'other' END AS made FROM (SELECT DISTINCT column_id, name FROM table_columns)"


def table_cells(spark, sf_dir):
    """The header cells of each table as one line of `role: name` pairs, blank names left out."""
    cols = read_table(spark, sf_dir, "table_columns").dropDuplicates(["column_id"]).where("name IS NOT NULL")
    maps = cols.groupBy("table_id").agg(F.map_from_entries(F.collect_list(F.struct(F.format_string("%03d", "column_index"), T.collapse(F.col("name"))))).alias("cells"))
    return maps.select("table_id", T.render_cells(F.col("cells")).alias("line"))


SQL["table_cells"] = f"SELECT table_id, coalesce(string_agg(printf('%03d', column_index) || ': ' || {CLEAN}, '; ' ORDER BY column_index) FILTER ({CLEAN} <> ''), '') AS line FROM (SELECT DISTINCT column_id, table_id, column_index, name FROM table_columns WHERE name IS NOT NULL) GROUP BY 1"


def event_props(spark, sf_dir):
    k = F.from_json("props", "k int").getField("k")
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count_if(k.isNull()).alias("missing"))


SQL["event_props"] = "SELECT event_type, sum((props::JSON ->> 'k')::INT)::BIGINT AS total, count(*) FILTER ((props::JSON ->> 'k') IS NULL) AS missing FROM events GROUP BY 1"


def ids_by_document(spark, sf_dir):
    """Local ids under their document's key, and the key taken apart again."""
    rows = _subs(spark, sf_dir)
    return rows.select("sub_question_id", (F.concat_ws("#", "doc_key", "sub_question_local") == F.col("sub_question_id")).alias("consistent"), F.element_at(F.split("doc_key", "/"), 2).alias("house"))


SQL["ids_by_document"] = "SELECT DISTINCT sub_question_id, doc_key || '#' || sub_question_local = sub_question_id AS consistent, split_part(doc_key, '/', 2) AS house FROM sub_questions"


def grounded_answers(spark, sf_dir):
    """The share of an answer's words that its question has too."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0))
    rows = _subs(spark, sf_dir).where("answer_text IS NOT NULL").select("sub_question_id", F.round(T.grounding(words(F.col("answer_text")), words(F.col("question_text"))), 6).alias("overlap"))
    return rows.withColumn("grounded", F.col("overlap") >= 0.5)


SQL["grounded_answers"] = f"SELECT sub_question_id, overlap, overlap >= 0.5 AS grounded FROM (SELECT sub_question_id, round(coalesce(len(list_intersect(a, q)) / nullif(len(a), 0), 0), 6) AS overlap FROM (SELECT sub_question_id, list_distinct(regexp_extract_all(lower(answer_text), '[a-z]+')) AS a, list_distinct(regexp_extract_all(lower(question_text), '[a-z]+')) AS q FROM {SUBS} WHERE answer_text IS NOT NULL))"


def display_lines(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", T.shorten(F.regexp_replace("text", r"\s+", " ")).alias("short"), F.length(T.numbered_lines(F.col("text"))).alias("numbered"))


SQL["display_lines"] = "SELECT doc_id, CASE WHEN length(t) > 40 THEN left(t, 39) || '…' ELSE t END AS short, length(array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: i || ': ' || x), chr(10))) AS numbered FROM (SELECT doc_id, text, regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL)"


def source_files(spark, sf_dir):
    """Files of the documents: kind, noise, score of the name, and the folder of the question."""
    f = F.col("file_metadata")
    path = f["relative_path"]
    return _docs(spark, sf_dir).select("doc_key", T.content_type(path).alias("media_type"), T.is_noise(path).alias("noise"), T.file_score(f["original_filename"]).alias("score"), F.array_join(F.slice(F.split(path, "/"), 1, 3), "/").alias("folder"), f["size_bytes"].alias("bytes"))


LOWNAME = "lower(f.original_filename)"
SQL["source_files"] = f"""SELECT doc_key, CASE lower(regexp_extract(f.relative_path, '(\\.[A-Za-z0-9]+)$', 1)) WHEN '.pdf' THEN 'application/pdf' WHEN '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN '.doc' THEN 'application/msword' WHEN '.xlsx' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' WHEN '.xls' THEN 'application/vnd.ms-excel' WHEN '.txt' THEN 'text/plain' ELSE 'application/octet-stream' END AS media_type,
 regexp_matches(f.relative_path, '(^|/)(\\.|~\\$)|\\.(tmp|lnk|download|db|ini)$') AS noise,
 CASE WHEN regexp_matches({LOWNAME}, '\\b(reply|answer|ans|response)\\b') THEN 3 ELSE 0 END - CASE WHEN regexp_matches({LOWNAME}, '\\b(covering\\s*letter|forwarding|note|briefing|minutes|agenda|index|email|corrigendum)\\b') THEN 3 ELSE 0 END + CASE WHEN regexp_matches({LOWNAME}, '\\bapproved\\b') THEN 40 WHEN regexp_matches({LOWNAME}, '\\bfinal\\b') THEN 30 WHEN regexp_matches({LOWNAME}, '\\brevised') THEN 20 WHEN regexp_matches({LOWNAME}, '\\bdraft\\b') THEN -10 ELSE 0 END AS score,
 array_to_string(string_split(f.relative_path, '/')[1:3], '/') AS folder, f.size_bytes AS bytes FROM (SELECT DISTINCT doc_key, file_metadata AS f FROM parsed)"""


def path_slices(spark, sf_dir):
    """Documents, pages and bytes under each session and house folder."""
    rows = _docs(spark, sf_dir).select("doc_key", "page_count", F.col("file_metadata.size_bytes").alias("bytes"), F.split("doc_key", "/").alias("p"))
    cut = rows.select("page_count", "bytes", F.explode(F.array(F.get("p", F.lit(0)), F.concat_ws("/", F.get("p", F.lit(0)), F.get("p", F.lit(1))))).alias("folder"))
    return cut.groupBy("folder").agg(F.count("*").alias("documents"), F.sum("page_count").alias("pages"), F.sum("bytes").alias("bytes"))


SQL["path_slices"] = "SELECT folder, count(*) AS documents, sum(page_count)::BIGINT AS pages, sum(bytes)::BIGINT AS bytes FROM (SELECT doc_key, page_count, file_metadata.size_bytes AS bytes, unnest([split_part(doc_key, '/', 1), split_part(doc_key, '/', 1) || '/' || split_part(doc_key, '/', 2)]) AS folder FROM (SELECT DISTINCT doc_key, page_count, file_metadata FROM parsed)) GROUP BY 1"


def paragraph_scan(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\n[ \t]*\n")).alias("n", "paragraph"))
    return rows.where(F.regexp_replace("paragraph", r"[ \t\r\n]", "") != "").groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.max(F.length("paragraph")).alias("longest"), F.max("n").alias("last_n"))


SQL["paragraph_scan"] = "SELECT doc_id, count(*) AS paragraphs, max(length(p)) AS longest, (max(n) - 1)::INT AS last_n FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS n FROM (SELECT doc_id, string_split_regex(text, '\\n[ \\t]*\\n') AS ps FROM documents WHERE text IS NOT NULL)) WHERE regexp_replace(p, '[ \\t\\r\\n]', '', 'g') <> '' GROUP BY 1"


def content_hashes(spark, sf_dir):
    """Documents with the same content, by hash: how many, and the first."""
    rows = read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return rows.groupBy("sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


SQL["content_hashes"] = "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1"


def age_literals(spark, sf_dir):
    """Ages given as text read as seconds: here from the page count of each document."""
    pages = F.col("page_count")
    literal = F.concat(pages.cast("string"), F.when(pages % 3 == 0, "d").when(pages % 3 == 1, "h").otherwise("m"))
    return _docs(spark, sf_dir).where("page_count IS NOT NULL").select("doc_key", literal.alias("age"), T.seconds_of(literal).alias("seconds"))


SQL["age_literals"] = "SELECT DISTINCT doc_key, page_count || CASE page_count % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'h' ELSE 'm' END AS age, page_count * CASE page_count % 3 WHEN 0 THEN 86400 WHEN 1 THEN 3600 ELSE 60 END AS seconds FROM parsed WHERE page_count IS NOT NULL"


def queries():
    return {name: f for name, f in globals().items() if callable(f) and not name.startswith("_") and name in SQL} | {"dated_references": dated_references}


def oracle_sql():
    return SQL
