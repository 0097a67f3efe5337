"""Defects of question and answer pairs.

Rules on the single pair find empty, copied, refusing and foreign-language answers. A
truncated answer shows only against the corpus: answers are sorted as texts, so that those
that continue an answer stand right after it; how often a run of words ends a
sentence is counted over all answers; and lengths at which unfinished answers pile up are
taken as length limits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarkash.llm.similar import WORDS
from tarkash.sources.tables import checkpoint, spread

# Function words that tell languages of one script apart.
FUNCTION_WORDS = {
    "en": "the of and in to was is for by at on has been with as that are were be this which from it not",
    "hi-latn": "ka ki ke ko mein hai hain gaya gayi gaye tak par se ne aur tatha kintu lekin jaisa diya kiya tha thi jiski iska raha",
    "hi": "है हैं का की के को में से ने था थी थे और तथा गया गई गए लिए किया पर यह कि",
    "mr": "आहे आहेत आणि च्या मध्ये केले केली होते होती होता यांचा वर साठी झाले झाली आली व हे ते असून",
    "ne": "छ छन् छैन मा ले गरिएको भएको थियो थिए र हरू लाई गरेको भने पनि यो त्यो हो वटा",
    "bn": "এর এবং হয়েছে করা জন্য এই থেকে টি যা হবে",
}
SCRIPT_LANGUAGES = {"latin": ("en", "hi-latn"), "devanagari": ("hi", "mr", "ne"), "bengali": ("bn",)}
# Labels that may stand before an answer.
LABEL = re.compile(r"^(?:\s|[​‌‍﻿])*(?:(?:reply|answer|ans|response|उत्तर|जवाब|उत्तरे|উত্তর|जवाफ)\s*[.:\-–—)]*\s*|\(?\s*[a-zA-Zivx]{1,3}\s*\)\s*(?:(?:to|and|&|,|से|-|–)\s*\(?\s*[a-zA-Zivx]{1,3}\s*\))*\s*[.:\-–—]*\s*|sir,\s*)", re.I)
SENTENCE = re.compile(r"[^.।?!\n]+(?:\.(?=\S)[^.।?!\n]*)*(?:[.।?!]+|\n|$)")
ENDED = re.compile(r"[.।॥?!][\s\"'”’)\]]*(?:\(\s*[a-z]\s*\)\s*(?:to|and|&)\s*\(\s*[a-z]\s*\)\s*\.?)?\s*$")
CUT_MARK = re.compile(r"(?:[,;:(\[{\-–—/]|\.\.\.*|…|\b(?:contd|cont|continued)\.?)\s*$", re.I)
# Ways to decline. A sentence declines if it has a word of refusal and speaks of giving what is asked.
REFUSES = re.compile(r"\b(?:no (?:reply|answer|information|comments?|details?|particulars|figures|data) (?:can|could|may|will|shall|is|are)\b|declin\w+|unable|cannot|can not|could not|will not|may not|must not|not (?:being |be )?(?:disclos\w+|furnish\w+|shared?|provid\w+|releas\w+|permitted|possible|entertained|inclined)|not in a position|not (?:be )?in the public interest|withh[eo]ld\w*|confidential|refus\w+)", re.I)
ASKED = re.compile(r"\b(?:information|particulars|details|data|figures|questions?|queries|query|lists?|disclos\w+|issue|the same|answer\w*|comment|request\w*|repl(?:y|ies)|documents?|records?|copy|matter asked)\b", re.I)
REFUSES_HI = re.compile("असमर्थ|गोपनीय|इनकार|अस्वीकार|संभव नहीं|नहीं (?:किया|किए|की|कराए|कराई|दी|दिया) जा सक|मना करत|असमर्थता|उपलब्ध नहीं करा|শক্য নহে|গোপনীয়|অক্ষম|সম্ভব নয়|शक्य नाही|देता येणार नाही|असमर्थ छ|सकिँदैन|गोप्य")
ASKED_HI = re.compile("सूचना|जानकारी|विवरण|आँकड़े|आंकड़े|उत्तर|प्रश्न|ब्यौरा|माहिती|तपशील|তথ্য|উত্তর|প্রশ্ন")
BARE = re.compile("खेद|अधिक कुछ नहीं|regret|nothing further|no further|thank", re.I)
ASSIGN = re.compile(r"\b(?:pertains?|transferred|forwarded|administrative ministry|may be (?:given|replied)|concerns? the)\b", re.I)
DIGITS = re.compile(r"\d+")
_KNOWN = {w: {c for c, ws in FUNCTION_WORDS.items() if w in ws.split()} for ws in FUNCTION_WORDS.values() for w in ws.split()}


def script_of(text: str) -> Counter:
    """Letters of a text by script."""
    c: Counter = Counter()
    for ch in text:
        if ch.isalpha():
            o = ord(ch)
            c["latin" if o < 0x250 else "devanagari" if 0x900 <= o < 0x980 else "bengali" if 0x980 <= o < 0xA00 else "other"] += 1
    return c


def languages_of(text: str) -> set[str]:
    """Languages in which a text has at least a fifth of its letters (romanised Hindi is hi)."""
    latin = len(re.findall(r"[A-Za-z]", text))
    devanagari = len(re.findall("[ऀ-ॿ]", text))
    bengali = len(re.findall("[ঀ-৿]", text))
    total = latin + devanagari + bengali
    out = set()
    for script, n in (("latin", latin), ("devanagari", devanagari), ("bengali", bengali)):
        if total and n >= 0.2 * total:
            votes: Counter = Counter()
            for w in WORDS(text.lower()):
                votes.update(_KNOWN.get(w, ()))
            best = max(SCRIPT_LANGUAGES[script], key=lambda c: votes[c])  # ties: the first
            out.add("hi" if best == "hi-latn" else best)
    return out


def _bare(answer: str) -> str:
    last = None
    while last != answer:
        last, answer = answer, LABEL.sub("", answer, count=1)
    return answer


def rule_defect(question: str | None, answer: str | None) -> str | None:
    """empty, copied, refusal or other_language, as far as the pair alone shows it."""
    body = _bare(answer or "")
    if not any(c.isalnum() for c in body):
        return "empty"
    q, a = WORDS((question or "").lower()), WORDS(body.lower())
    if len(a) >= 5 and len(q) >= 5:
        grams = set(zip(q, q[1:], q[2:], strict=False))
        if a[1] in q and sum(g in grams for g in zip(a, a[1:], a[2:], strict=False)) >= 0.85 * (len(a) - 2):
            return "copied"
    if REFUSES.search(body) or REFUSES_HI.search(body):
        declined = other = 0
        for s in SENTENCE.findall(body):
            if (REFUSES.search(s) and ASKED.search(s) or REFUSES_HI.search(s) and ASKED_HI.search(s)) and not ASSIGN.search(s):
                declined += 1
            elif any(c.isalpha() for c in s) and not BARE.search(s) and len(WORDS(s)) > 2:
                other += 1
        if declined and not other:
            return "refusal"
    if len(a) >= 4:
        asked, said = languages_of(question or ""), languages_of(body)
        if asked and said and not asked & said:
            return "other_language"
    return None


def _shape(text: str) -> list[str]:
    """Words with numbers as 0 and capitalised words inside a sentence as <n>."""
    shout = text.isupper()
    out = []
    for w in WORDS(text):
        out.append("0" if w[0].isdigit() else "<n>" if w[0].isupper() and not shout and not w.isupper() else w.lower())
    return out


def _keys(words: list[str]) -> list[str]:
    return [" ".join(words[-k:]) for k in (3, 2, 1) if len(words) >= k]


def _judge(newest: str | None):
    schema = pa.schema([("id", pa.string()), ("at", pa.timestamp("us", tz="UTC")), ("defect", pa.string()), ("text", pa.string()), ("length", pa.int64()), ("open", pa.bool_()), ("cut", pa.bool_()), ("keys", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, questions, answers = (batch.column(i).to_pylist() for i in range(4))
            out: dict[str, list] = {c: [] for c in schema.names}
            for i, when, q, a in zip(ids, at, questions, answers, strict=True):
                defect = rule_defect(q, a)
                body = (a or "").strip()
                cut = defect is None and bool(CUT_MARK.search(body))
                loose = cut or defect is None and not ENDED.search(body)
                rest = CUT_MARK.sub("", body)
                row = (i, when, defect, body if loose else None, len(a or ""), loose, cut, _keys(_shape(rest[-120:])) if loose else None)
                for c, v in zip(schema.names, row, strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def _count_ends(most: int = 400_000):
    """How often runs of up to three words end a sentence, and occur."""

    def out(total: Counter, ends: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": list(total), "total": pa.array(list(total.values()), pa.int64()), "ends": pa.array([ends[k] for k in total], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        ends: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                sentences = SENTENCE.findall(CUT_MARK.sub("", (text or "").strip()))
                for at, sentence in enumerate(sentences, 1):
                    w = _shape(sentence)
                    two = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
                    three = [f"{a} {b}" for a, b in zip(two, w[2:], strict=False)]
                    total.update(w)
                    total.update(two)
                    total.update(three)
                    if at == len(sentences) or sentence.rstrip()[-1:] in ".।?!":
                        ends.update(_keys(w))
            if len(total) > most:
                yield out(total, ends)
                total, ends = Counter(), Counter()
        if total:
            yield out(total, ends)

    return run


CLOSERS = ".।॥?!"


def _continued():
    """Of sorted distinct texts those that a later one continues by more than a closing mark.

    What a text can be continued by follows it directly, those first that go on with a mark;
    `pending` texts wait for one that does not. A range tells of its end which texts still
    wait, and of its start the first text and at which of its marks another one of the range
    goes on without.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first, shared, turns = None, 0, []
        pending: list[str] = []

        def out(kind: str, texts: list[str], at: list[int]) -> pa.RecordBatch:
            n = len(texts)
            return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([kind] * n, pa.string()), pa.array(texts, pa.string()), pa.array([at] * n, pa.list_(pa.int32()))], names=["part", "kind", "text", "turns"])

        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                if first is None:
                    first, shared = text, len(text)
                elif shared:
                    same = next((i for i, (x, y) in enumerate(zip(text[:shared], first, strict=False)) if x != y), min(shared, len(text)))
                    if same < len(first) and first[same] in CLOSERS and text[same : same + 1] not in CLOSERS:
                        turns.append(same)
                    shared = same
                while pending and not text.startswith(pending[-1]):
                    pending.pop()
                found += [p for p in pending if text[len(p)] not in CLOSERS]
                pending = [p for p in pending if text[len(p)] in CLOSERS]
                pending.append(text)
            if found:
                yield out("found", found, [])
        if first is not None:
            yield out("first", [first], turns)
            yield out("pending", pending, [])

    return run


def continued_texts(texts: DataFrame, column: str) -> DataFrame:
    """`text`: the distinct values of a column, without closing marks and blanks at their end, that another value continues by more than closing marks.

    One pass over range-partitioned, sorted texts compares each with those that follow it;
    what still waits at the end of a range is held against the start of the next one.
    """
    bare = F.regexp_replace(F.trim(F.col(column)), rf"[{CLOSERS}\s]+$", "")
    ranges = texts.select(bare.alias("text")).where("text <> ''").distinct().repartitionByRange("text").sortWithinPartitions("text")
    rows = checkpoint(ranges.mapInArrow(_continued(), "part int, kind string, text string, turns array<int>"))
    starts = rows.where("kind = 'first'").select("part", F.col("text").alias("next"), "turns")
    starts = starts.withColumn("part", F.lag("part").over(Window.orderBy("part")))  # one row a range
    waiting = rows.where("kind = 'pending'").select("part", "text").join(F.broadcast(starts), "part").where(F.col("next").startswith(F.col("text")))
    goes_on = F.substring(F.expr("substring(next, length(text) + 1)"), 1, 1)
    crossing = waiting.where(~goes_on.isin(*CLOSERS) | F.array_contains("turns", F.length("text"))).select("text")
    return rows.where("kind = 'found'").select("text").union(crossing).distinct()


def limit_lengths(rows: DataFrame) -> DataFrame:
    """Lengths at which unfinished answers pile up: at least 12, and six times the mean of the ten lengths around."""
    counts = rows.where("open").groupBy("length").agg(F.count("*").alias("n"))
    around = counts.select("length", "n", F.explode(F.sequence(F.lit(-5), F.lit(5))).alias("d")).select((F.col("length") + F.col("d")).alias("length"), F.when(F.col("d") == 0, F.col("n")).alias("own"), F.when(F.col("d") != 0, F.col("n")).alias("other"))
    return around.groupBy("length").agg(F.max("own").alias("own"), (F.coalesce(F.sum("other"), F.lit(0)) / 10).alias("mean")).where("own >= 12 AND own >= 6 * mean").select("length", F.lit(True).alias("limit"))


def defective_pairs(df: DataFrame, key: str, question: str, answer: str, *, newest: str | None = "loaded_at", least_end: float = 0.02) -> DataFrame:
    """`key` and `defect` of each defective pair; one row a key.

    Defects, the first that holds: empty (also a NULL answer), copied, refusal,
    other_language, truncated. Of a repeated key the row loaded last counts; rows without a
    key are left out; a NULL question counts as empty. An answer without a closing mark is
    truncated if it ends in a mark of cutting off, if many unfinished answers have just its
    length, or if its last words (three, else two, else one, seen at least three times
    elsewhere) end a sentence or answer in less than `least_end` of their occurrences; ten
    times that where another answer continues it.
    """
    at = F.col(newest).cast("timestamp") if newest else F.lit(None).cast("timestamp")
    rows = df.select(F.col(key).cast("string").alias("id"), at.alias("at"), F.col(question).alias("q"), F.col(answer).alias("a")).where("id IS NOT NULL")
    rows = spread(rows, "id")
    judged = rows.mapInArrow(_judge(newest), "id string, at timestamp, defect string, text string, length bigint, open boolean, cut boolean, keys array<string>")
    state = F.struct("defect", "text", "length", "open", "cut", "keys")
    state = judged.groupBy("id").agg(F.max_by(state, F.coalesce("at", F.timestamp_seconds(F.lit(0)))).alias("s")).select("id", "s.*")
    state = checkpoint(state.where("defect IS NOT NULL OR open"))
    answers = rows.select("a").where("a IS NOT NULL")
    counts = answers.mapInArrow(_count_ends(), "key string, total bigint, ends bigint").groupBy("key").agg(F.sum("total").alias("total"), F.sum("ends").alias("ends"))
    loose = state.where("open")
    tails = loose.select("id", F.posexplode("keys").alias("level", "key"))
    seen = tails.join(counts, "key").where("total > 3").groupBy("id").agg(F.min_by((F.col("ends") - 1) / (F.col("total") - 1), "level").alias("end"))  # without its own
    longer = continued_texts(answers, "a").withColumn("longer", F.lit(True))
    limits = limit_lengths(state)
    cut = loose.join(seen, "id", "left").join(longer, "text", "left").join(F.broadcast(limits), "length", "left")  # a limit needs 12 answers: few rows
    end = F.coalesce("end", F.lit(0.0))
    cut = cut.where(F.col("cut") | F.col("limit") | (end < F.when(F.col("longer"), 10 * least_end).otherwise(least_end)))
    return state.where("defect IS NOT NULL").select(F.col("id").alias(key), "defect").unionByName(cut.select(F.col("id").alias(key), F.lit("truncated").alias("defect")))
