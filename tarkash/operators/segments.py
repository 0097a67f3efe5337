"""Replies cut into parts, and answers grouped by the parts that share them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarkash.functions.replies import ANSWER_MARK
from tarkash.functions.text import bind, collapse

MARKER = r"\(\s*([a-z]|[ivx]{1,4})\s*\)"


def parts(text: Column) -> Column:
    """Parts of a text at its markers `(a)`, `(b)`, ...: array of (label, body); text before the first marker has no label.

    A body ends at the next marker. A text without markers is one part.
    """
    marks = lambda t: F.regexp_extract_all(t, F.lit(MARKER), 1)
    bodies = lambda t: F.split(t, MARKER)
    made = bind(F.struct(marks(text).alias("m"), bodies(text).alias("b")), lambda s: F.transform(s["b"], lambda body, i: F.struct(F.when(i > 0, F.get(s["m"], i - 1)).alias("label"), collapse(body).alias("body"))))
    return F.filter(made, lambda p: p["label"].isNotNull() | (p["body"] != ""))


def with_shared(parts_: Column) -> Column:
    """Parts whose body is blank take the body of the next part that has one: `(a) to (c)` answered together."""
    later = lambda i: F.get(F.filter(F.slice(parts_, i + 1, F.size(parts_)), lambda p: F.regexp_replace(p["body"], r"[\s,&]|and|to", "") != ""), F.lit(0))["body"]
    return F.transform(parts_, lambda p, i: F.struct(p["label"].alias("label"), F.coalesce(F.when(F.regexp_replace(p["body"], r"[\s,&]|and|to", "") != "", p["body"]), later(i), p["body"]).alias("body")))


def blocks(text: Column, least: int = 300) -> Column:
    """Headed blocks of a long answer (heading lines end in a colon): array of (heading, text); none for shorter ones or fewer than two."""
    cut = F.transform(F.split(text, r"\n(?=[^\n]{3,60}:\s*\n)"), lambda b: F.struct(F.regexp_extract(b, r"^\s*([^\n]{3,60}):\s*\n", 1).alias("heading"), collapse(F.regexp_replace(b, r"^\s*[^\n]{3,60}:\s*\n", "")).alias("text")))
    return bind(cut, lambda c: F.when((F.length(text) >= least) & (F.size(c) >= 2), c).otherwise(F.slice(c, 1, 0)))


def _due(piece: Column, due: Column, starts: bool) -> Column:
    """The label due after those of a text: each that was due moves on by a letter; a run starts at a or b, if it may."""
    labels = F.regexp_extract_all(F.lower(piece), F.lit(r"\(\s*([a-z])\s*\)"), 1)
    fits = lambda d, x: (x == d) | ((d == "") & x.isin("a", "b")) if starts else x == d
    return F.aggregate(labels, due, lambda d, x: F.when(fits(d, x), F.char(F.ascii(x) + 1)).otherwise(d))


def answers_of(text: Column) -> Column:
    """Answers of a reply: each begins at a mark (`Answer:`) and ends at the next one or at the next question, whichever is first.

    Questions are labels that carry on a run (a), (b), ... begun before the first mark; other
    labels belong to the answer. Blank answers are left out; a text without marks has none.
    """

    def step(s: Column, piece: Column) -> Column:
        cut = F.when(s["due"] == "", F.array(piece)).otherwise(F.split(piece, F.concat(F.lit(r"(?i)\(\s*"), s["due"], F.lit(r"\s*\)")), 2))
        rest = F.get(cut, F.lit(1))
        answer = collapse(F.get(cut, F.lit(0)))
        due = F.when(rest.isNull(), s["due"]).otherwise(_due(rest, F.char(F.ascii(s["due"]) + 1), False))
        return F.struct(due.alias("due"), F.when(answer == "", s["answers"]).otherwise(F.concat(s["answers"], F.array(answer))).alias("answers"))

    def run(pieces: Column) -> Column:
        start = F.struct(_due(F.get(pieces, F.lit(0)), F.lit(""), True).alias("due"), F.array().cast("array<string>").alias("answers"))
        return F.aggregate(F.slice(pieces, 2, F.size(pieces)), start, step)["answers"]

    return bind(F.split(text, ANSWER_MARK), run)


def recovered(question: Column, source: Column) -> Column:
    """What a source answers to a question: the text after the first mark that follows the question's first 40 characters, up to the next label.

    Case and white space are ignored in the search. NULL where the question or a mark after it is missing.
    """
    needle = F.substring(F.lower(collapse(F.regexp_replace(question, r"^\s*\([a-z0-9]+\)\s*", ""))), 1, 40)
    plain = collapse(source)
    at = F.when(needle != "", F.position(needle, F.lower(plain)))
    answer = F.when(at > 0, F.get(F.split(plain.substr(at, F.length(plain)), ANSWER_MARK, 2), F.lit(1)))
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(answer, r"\s*\([a-z]\)\s.*$", "")), F.lit("")), F.nullif(F.trim(answer), F.lit("")))


def verify_spans(spans: DataFrame, key: str, lines: str) -> DataFrame:
    """Spans (`first`, `last`, from 1) with `errors`: out of range, reversed, overlapping the one before, or a repeated label."""
    order = Window.partitionBy(key).orderBy("first", "last", "label")
    same = Window.partitionBy(key, "label").orderBy("first", "last")
    found = F.array(
        F.when((F.col("first") < 1) | (F.col("last") > F.col(lines)), "range"), F.when(F.col("last") < F.col("first"), "reversed"),
        F.when(F.lag("last").over(order) >= F.col("first"), "overlap"), F.when(F.row_number().over(same) > 1, "label"),
    )
    return spans.withColumn("errors", F.filter(found, lambda e: e.isNotNull()))


def shared_groups(parts_: DataFrame, key: str) -> DataFrame:
    """Parts numbered by the answer that they share: the same span, else the same wording; parts without either stand alone."""
    span = F.when(F.col("first").isNotNull(), F.concat_ws("-", "first", "last"))
    same = F.coalesce(span, F.nullif(F.lower(collapse(F.col("body"))), F.lit("")), F.concat(F.lit("\0"), "label"))
    rows = parts_.withColumn("_same", same)
    w = Window.partitionBy(key, "_same")
    return rows.withColumn("_least", F.min("label").over(w)).withColumn("answer_group", F.dense_rank().over(Window.partitionBy(key).orderBy("_least", "_same"))).drop("_same", "_least")
