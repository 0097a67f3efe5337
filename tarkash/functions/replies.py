"""Signals and fields of replies: what they are, whom they are for, what they point to, and JSON that models give.

All take and return Columns; NULL stays NULL unless a docstring says otherwise. Patterns keep
to what both Java's and RE2's expressions mean alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarkash.functions.text import annexure_labels, bind, collapse, label_number

# Words that mark replies, letters, mails and tables; review flags; kinds of entities and names that are none.
ANSWER_MARK = r"(?i)\b(?:comment|answer|reply)\b\s*[:.-]"
LETTER_MARK = r"(?i)\bsir\s*,|\bdear\s+sir\b|\byours\s+faithfully\b|\bcovering\s+letter\b|\bkind\s+attention\b"
BELOW = r"(?i)\b(?:given|shown|tabulated|detailed|as)\s+(?:here)?(?:below|under)\b|\bas\s+follows\b|\bfollowing\s+(?:table|details)\b"
MAIL_HEADERS = ("from", "to", "cc", "subject", "sent")
REVIEW_FLAGS = (
    "no_answer_file", "empty_or_unreadable", "schema_validation_failed", "low_confidence_pair", "no_pairs_extracted", "format_converted", "ocr_used", "phase1_flagged", "qa_table_columns_inferred", "table_alignment_uncertain",
    "ambiguous_latest_reply", "answer_from_all_versions_fallback", "pdfplumber_fallback", "ocr_unavailable", "format_conversion_unavailable", "read_error", "email_wrapper_reply_may_be_attachment", "qa_table_row_stitched", "table_wrapped_rows_stitched",
    "empty_answer_after_recovery", "answer_in_annexure_not_present", "covering_letter_format", "no_diary_number_found", "annexure_match_ambiguous", "table_group_uncertain", "qa_count_mismatch", "group_link_broken", "llm_crosscheck_disagree", "annexure_ref_unresolved",
)
ENTITY_KINDS = ("project", "state", "scheme", "organization")
NOT_ENTITIES = ("hydro projects", "power station", "under construction", "power project", "hydro project", "hydroelectric project", "projects")
REPLY_FOLDERS = ("reply", "replies", "answer", "answers", "final reply")


def starred_of(text: Column) -> Column:
    """False for `unstarred`, true for `starred`, NULL where the text says neither."""
    return F.when(text.rlike(r"(?i)\bunstarred\b"), False).when(text.rlike(r"(?i)\bstarred\b"), True)


def subject_of(text: Column) -> Column:
    """What follows `regarding`, `subject:` or `on the subject`, up to a quote or the end of the line; NULL if under four letters."""
    found = F.trim(F.regexp_extract(text, r"(?i)(?:\bregarding\b|\bsubject\s*[:-]|\bon the subject\b)[ \t]*['\"]?([^'\"\n]{4,120})", 1))
    return F.nullif(found, F.lit(""))


def diary_numbers(text: Column) -> Column:
    """Numbers after `diary no.` or `question no.`, several where they are listed; none for NULL."""
    listed = F.regexp_extract(text, r"(?i)(?:\bdiary|\bdy\.?|\bquestion)\s*(?:dy\.?\s*)?no\.?s?\s*[:.]?\s*([A-Z]?-?[0-9]{2,6}(?:\s*(?:,|&|and|/)\s*[A-Z]?-?[0-9]{2,6})*)", 1)
    return F.coalesce(F.array_distinct(F.transform(F.regexp_extract_all(listed, F.lit("(?i)([A-Z]?-?[0-9]{2,6})"), 1), F.upper)), F.array().cast("array<string>"))


def points_to_table(text: Column) -> Column:
    """Whether an answer stands in a table that follows it; one that names an annexure points to a file instead."""
    return text.rlike(BELOW) & (F.size(annexure_labels(text)) == 0)


def reply_format(text: Column, parts: Column, answered: Column) -> Column:
    """covering_letter, unknown (fewer than two parts), interleaved (all parts but one answered) or questions_then_answers."""
    few = F.coalesce(parts, F.lit(0)) < 2
    return F.when(few & text.rlike(LETTER_MARK), "covering_letter").when(few | text.isNull(), "unknown").when(answered >= F.greatest(F.lit(2), parts - 1), "interleaved").otherwise("questions_then_answers")


def is_mail_wrapper(text: Column) -> Column:
    """Whether a text is a forwarded mail whose reply is attached: two signs of a mail and little text, or three signs."""
    head = F.lower(F.substring(text, 1, 1200))
    headers = sum((head.rlike(rf"\b{h}\s*:").cast("int") for h in MAIL_HEADERS), F.lit(0)) >= 2
    attached = text.rlike(r"(?i)\b[0-9]+\s+attachments?\b|\.(?:docx?|pdf|xlsx?)\s+[0-9]+\s*[KM]B")
    signs = headers.cast("int") + attached.cast("int") + head.rlike(r"\b(?:fwd|re):\s").cast("int")
    return (signs >= 3) | ((signs == 2) & (F.length(F.trim(text)) < 1800))


def looks_like_place(name: Column, known: tuple[str, ...] = ()) -> Column:
    """Whether a folder's name could be a state's: letters only, more than one, and no word for replies or a known category."""
    low = F.lower(collapse(name))
    return ~low.isin(*REPLY_FOLDERS, *known) & low.rlike(r"^[a-z&. ]{2,}$")


def question_number(raw: Column, own: Column) -> Column:
    """(number, label): a stated number if it is one, else the document's own; a part's label that stood in its place is kept."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    label = s.rlike(r"(?i)^\(?(?:[a-z]|[ivx]{1,4})\)?$")
    return F.struct(F.when(s.rlike("^[A-Za-z]{0,4}[- ]?[0-9]{1,6}[A-Za-z]?$"), s).otherwise(F.coalesce(F.nullif(own, F.lit("")), F.nullif(s, F.lit("")), F.lit("unknown"))).alias("number"), F.when(label, s).alias("label"))


def before_mark(text: Column) -> Column:
    """The text before the first mark of an answer; empty where there is none."""
    return F.when(text.rlike(ANSWER_MARK), F.trim(F.get(F.split(text, ANSWER_MARK, 2), F.lit(0)))).otherwise(F.when(text.isNotNull(), ""))


def after_mark(text: Column) -> Column:
    """The text after the first mark of an answer; the whole text where there is none."""
    return F.trim(F.element_at(F.split(text, ANSWER_MARK, 2), -1))


def annexure_numbers(file: Column) -> Column:
    """Numbers of the annexures that a file's name names; 0 for an annexure without a number, none for other files."""
    numbers = F.array_distinct(F.filter(F.transform(annexure_labels(file), lambda x: label_number(F.substring(x, 10, 9))), lambda n: n.isNotNull()))
    return F.when(F.size(numbers) > 0, numbers).when(file.rlike("(?i)annex"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))


def iso_time(text: Column) -> Column:
    """A time from ISO text with a zone, Z or none (UTC); NULL for other text."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "Z$", "+00:00"))


def one_of(value: Column, allowed: tuple[str, ...]) -> Column:
    """The value if it is allowed, else NULL."""
    return F.when(value.isin(*allowed), value)


def bare_json(raw: Column) -> Column:
    """Model output without a fence around it and without what stands before its first bracket."""
    plain = F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*|\s*```$", "")
    return F.regexp_replace(plain, r"(?s)^[^\[{]*(?=[\[{])", "")


def closed_json(raw: Column) -> Column:
    """JSON that was cut off, with its open string and brackets closed; a comma or colon left hanging goes."""

    def step(s: Column, ch: Column) -> Column:
        text, esc, open_ = s["text"], s["esc"], s["open"]
        quote = (ch == '"') & ~esc
        stack = F.when(text | quote, open_).when(ch == "{", F.concat(F.lit("}"), open_)).when(ch == "[", F.concat(F.lit("]"), open_)).when(ch.isin("}", "]"), open_.substr(F.lit(2), F.length(open_))).otherwise(open_)
        return F.struct(F.when(quote, ~text).otherwise(text).alias("text"), ((ch == "\\") & text & ~esc).alias("esc"), stack.alias("open"))

    start = F.struct(F.lit(False).alias("text"), F.lit(False).alias("esc"), F.lit("").alias("open"))

    def close(p: Column) -> Column:
        end = F.aggregate(F.split(p, ""), start, step)
        kept = lambda e: F.when(e["text"], F.concat(p, F.lit('"'))).otherwise(F.regexp_replace(p, r"[,:]\s*$", ""))
        return bind(end, lambda e: F.concat(kept(e), e["open"]))

    return bind(bare_json(raw), close)


def verdicts(raw: Column) -> Column:
    """(id, verdict, reason) of a model's array; items without a whole id or a known verdict are left out, and unreadable output is NULL."""
    items = F.from_json(bare_json(raw), "array<struct<id:string,verdict:string,reason:string>>")
    good = F.filter(items, lambda x: x["id"].rlike("^-?[0-9]+$") & F.lower(x["verdict"]).isin("similar", "not_similar"))
    return F.transform(good, lambda x: F.struct(x["id"].cast("int").alias("id"), F.lower(x["verdict"]).alias("verdict"), F.substring(F.coalesce(x["reason"], F.lit("")), 1, 200).alias("reason")))


def model_entities(raw: Column) -> Column:
    """(name, kind) of a model's array: known kinds, names of four letters or more that are no common phrase."""
    items = F.from_json(bare_json(raw), "array<struct<name:string,type:string>>")
    good = F.filter(items, lambda x: (F.length(F.trim(x["name"])) >= 4) & ~F.lower(F.trim(x["name"])).isin(*NOT_ENTITIES) & F.lower(F.trim(x["type"])).isin(*ENTITY_KINDS))
    return F.transform(good, lambda x: F.struct(F.trim(x["name"]).alias("name"), F.lower(F.trim(x["type"])).alias("kind")))


def pair_errors(raw: Column) -> Column:
    """What is missing from each pair of a model's `{"pairs": [...]}`: `n:field`; a single `pairs` where there is no such list."""
    pairs = F.from_json(bare_json(raw), "pairs array<struct<question_number:string,question_text:string,answer_text:string,answer_is_table:boolean,confidence:string>>")["pairs"]

    def errors(p: Column, i: Column) -> Column:
        lacks = lambda c: p[c].isNull() & ~F.coalesce(p["answer_is_table"], F.lit(False))
        found = (F.when(p["question_number"].isNull(), "question_number"), F.when(lacks("question_text"), "question_text"), F.when(lacks("answer_text"), "answer_text"), F.when(~F.coalesce(p["confidence"], F.lit("high")).isin("high", "low"), "confidence"))
        return F.transform(F.filter(F.array(*found), lambda e: e.isNotNull()), lambda e: F.concat_ws(":", i.cast("string"), e))

    return F.when(pairs.isNull(), F.array(F.lit("pairs"))).otherwise(F.flatten(F.transform(pairs, errors)))


def review_reasons(flags: Column) -> Column:
    """The flags that call for a review."""
    return F.array_intersect(F.coalesce(flags, F.array().cast("array<string>")), F.lit(list(REVIEW_FLAGS)))
