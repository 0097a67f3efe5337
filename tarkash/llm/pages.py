"""Printed headers and page numbers of scanned pages, from the lines that open the blocks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarkash.sources.tables import checkpoint

# Characters that scanning confuses, each with the one that stands for its class.
CONFUSED = {"0": "o", "1": "l", "i": "l", "|": "l", "!": "l", "j": "l", "5": "s", "$": "s", "8": "b", "6": "b", "h": "b", "9": "g", "q": "g", "†": "t", "f": "t", "c": "e", "é": "e", "è": "e", "ë": "e", "ä": "a", "á": "a", "à": "a", "â": "a", "@": "a", "ö": "o", "ó": "o", "ò": "o", "ü": "u", "ú": "u", "û": "u", "í": "l", "ï": "l", "î": "l"}
CONFUSED_RUNS = (("rn", "m"), ("ii", "u"), ("ll", "u"), ("el", "d"), ("vv", "w"))
NUMBER = r"(?:(?i:page|pg|p)\.?\s*\d+(?:\s*(?i:of)\s*\d+)?|पृष्ठ\s*\d+(?:\s*/\s*\d+)?|पान\s*\d+|পৃষ্ঠা\s*\d+|\d+\s*/\s*\d+|[-–—]\s*\d+\s*[-–—]|\[\s*\d+\s*\]|\(\s*[ivxlc]+\s*\))"
#: A line that is nothing but a printed page number.
NUMBER_LINE = rf"^\s*(?:{NUMBER}|\d{{1,5}})\s*$"
#: A page number beside a header: after a wide gap, or of a form that nothing else has.
BESIDE = rf"(?:(?<=[^\s/])\s{{3,}}\d{{1,5}}\s*$|\s{{2,}}{NUMBER}\s*$|^\s*(?:{NUMBER}|\d{{1,5}})\s{{3,}})"


_FOLD = str.maketrans(CONFUSED)
_NUMBERED = re.compile(r"(?<!\S)\S*\d[\d/.,-]*\d\S*|\b[sS]?-?\d+\b")  # words with two digits or more, as a whole
_OTHER, _NUMBERS = re.compile(r"[^\w#\u0900-\u0dff]+|_+"), re.compile(r"(?:\s*#)+")
_NUMBER_LINE, _BESIDE, _DOT = re.compile(NUMBER_LINE), re.compile(BESIDE), re.compile(r"\s+\.$")
_DIGIT, _GAP = re.compile(r"\d").search, re.compile(r"\s\s").search


def folded(line: str) -> str:
    """Letters of a line by class of confusion; runs of digits are #."""
    s = (_NUMBERED.sub("#", line) if _DIGIT(line) else line).lower().translate(_FOLD)
    for a, b in CONFUSED_RUNS:
        s = s.replace(a, b)
    s = _OTHER.sub(" ", s)
    return (_NUMBERS.sub(" #", s) if "#" in s else s).strip()


def opening_line(text: str) -> str | None:
    """The first line of a text if it could be a header, without a page number beside it.

    It is short, without a closing mark, holds letters, and is more than a page number.
    """
    line = text.lstrip().split("\n", 1)[0].strip()
    if len(line) > 130 or line[-1:] in "।?!,;:" or (line[-1:] == "." and line[-2:-1] != " "):
        return None
    if not _NUMBER_LINE.match(line):
        line = _BESIDE.sub("", line).strip() if _GAP(line) else line  # a number beside stands after or before a gap
        line = _DOT.sub("", line) if line[-1:] == "." else line
        if len(line) <= 110 and sum(map(str.isalpha, line)) >= 3:
            return line
    return None


def opening_lines(blocks: DataFrame) -> DataFrame:
    """`block_id`, `doc_key`, `page`, `key`: the first line of each block that could be a header, by class of confusion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [folded(x) if x else "" for x in map(opening_line, batch.column(3).to_pylist())]
            kept = pa.array([len(k) >= 6 for k in keys])
            yield pa.RecordBatch.from_arrays([c.filter(kept) for c in (*batch.columns[:3], pa.array(keys, pa.string()))], names=["block_id", "doc_key", "page", "key"])

    kinds = dict(blocks.dtypes)
    line = F.when(F.col("text").startswith("\n") | F.col("text").startswith("\r"), F.regexp_replace("text", r"^\s+", "")).otherwise(F.ltrim("text"))
    rows = blocks.where("text IS NOT NULL AND doc_key IS NOT NULL").select("block_id", "doc_key", "page", F.explode(F.array(F.rtrim(F.substring_index(line, "\n", 1)))).alias("text"))  # as rows of one element, lines are cut once
    text = F.col("text")
    closed = reduce(or_, map(text.endswith, "।?!,;:"), text.endswith(".") & ~text.endswith(" ."))
    rows = rows.where((F.length("text") <= 130) & ~closed)  # what `opening_line` would refuse
    return rows.mapInArrow(run, f"block_id {kinds['block_id']}, doc_key string, page {kinds['page']}, key string")


def _folded(titles: DataFrame) -> DataFrame:
    """`doc_key`, `title`: the titles by class of confusion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(folded, batch.column(1).to_pylist()), pa.string())], names=["doc_key", "title"])

    return titles.mapInArrow(run, "doc_key string, title string")


def _words(keys: DataFrame, most: int = 400_000) -> DataFrame:
    """`w`, `n`: in how many keys a word is, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for key in batch.column(0).to_pylist():
                held.update(set(key.split(" ")))
            if len(held) > most:
                yield out(held)
                held = Counter()
        yield out(held)

    def out(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["w", "n"])

    return keys.mapInArrow(run, "w string, n bigint")


def _shaped(lines: DataFrame, common: frozenset) -> DataFrame:
    """`lines` with `shape`, the key with runs of other than common words as _."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = []
            for key in batch.column(batch.schema.get_field_index("key")).to_pylist():
                out: list[str] = []
                for w in key.split(" "):
                    if w in common or out[-1:] != ["_"]:
                        out.append(w if w in common else "_")
                shapes.append(" ".join(out))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shapes, pa.string())], names=[*batch.schema.names, "shape"])

    return lines.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in lines.dtypes) + ", shape string")


def header_lines(blocks: DataFrame, titles: DataFrame, *, least_pages: int = 2, least_share: float = 0.15, common: float = 0.001) -> DataFrame:
    """`block_id`: the blocks whose first line is a printed header of their document.

    A line is a header if, by class of confusion, it opens blocks on at least `least_pages`
    and `least_share` of its document's pages; if it is close to such a line of its document;
    or if its pattern (rare words left out) is that of headers in several documents, as in
    documents of one page. A line that is its document's title (`titles`: doc_key, title) is none.
    """
    lines = counted = checkpoint(opening_lines(blocks))  # short lines; read several times
    pages = blocks.where("doc_key IS NOT NULL").groupBy("doc_key").agg(F.countDistinct("page").alias("pages"))
    often = lines.groupBy("doc_key", "key").agg(F.countDistinct("page").alias("n")).where(F.col("n") >= least_pages)
    strong = often.join(pages, "doc_key").where(F.col("n") >= least_share * F.col("pages")).groupBy("doc_key").agg(F.collect_set("key").alias("marks"))  # at most 1 / least_share keys a page
    known = _folded(titles.where("doc_key IS NOT NULL AND title IS NOT NULL").select("doc_key", "title").distinct()).groupBy("doc_key").agg(F.collect_set("title").alias("titles"))
    documents = pages.join(strong, "doc_key", "left").join(known, "doc_key", "left")
    none = F.array().cast("array<string>")
    documents = documents.select("doc_key", "pages", F.array_except(F.coalesce("marks", none), F.coalesce("titles", none)).alias("marks"), F.coalesce("titles", none).alias("titles"))
    key = F.col("key")
    close = F.array_contains("marks", key) | F.exists("marks", lambda m: ((F.length(key) >= 14) & m.startswith(key)) | ((F.abs(F.length(m) - F.length(key)) <= 0.25 * F.length(m)) & (F.call_function("levenshtein", m, key, F.least(F.lit(27), F.floor(F.length(m) / 4)).cast("int")) >= 0)))
    lines = lines.join(documents, "doc_key").where(~F.array_contains("titles", key)).select("block_id", "doc_key", "key", close.alias("own"), (F.col("pages") >= 3).alias("long"))
    n = counted.count()
    words = _words(counted.select("key")).groupBy("w").agg(F.sum("n").alias("count"))
    kept = frozenset(r.w for r in words.where(F.col("count") >= max(8, common * n)).select("w").collect())  # at most (words a line) / common
    lines = checkpoint(_shaped(lines, kept).drop("key"))
    long = lines.where("long").groupBy("shape").agg(F.countDistinct("doc_key").alias("docs"), F.countDistinct(F.when(F.col("own"), F.col("doc_key"))).alias("with"))
    headers = long.where("with >= 2 AND with >= 0.4 * docs AND shape <> '_'").select("shape", F.lit(True).alias("usual"))
    return lines.join(headers, "shape", "left").where(F.col("own") | F.col("usual")).select("block_id").distinct()
