"""Languages of documents, blocks, column names and the segments of mixed blocks.

For each language a suffix automaton over its labelled text, word by word, gives the longest
run of words that the text holds from any place of a sentence. Cross-parsing a sentence
greedily into such runs takes few phrases in its own language and many in another. A word
that the text of a language lacks is parsed into longest matches of its letters by a second
automaton, over the language's vocabulary, and counts as the phrases that this takes. The
language that needs the fewest phrases wins, among the languages of the script.

The labels to learn from are themselves wrong in part. A bounded sample of labelled rows
(`SAMPLE_ROWS` a label, chosen by hash) is therefore cleaned first: its sentences are
reassigned among the languages of their script by word rates until they are stable, and
words that are ten times as frequent in another language break a text rather than join it.
Everything else runs over all rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarkash.llm.pages import BESIDE, NUMBER_LINE
from tarkash.llm.similar import WORDS
from tarkash.sources.tables import checkpoint, newest_per_key, newest_rows

SAMPLE_ROWS = 4000
#: Of the sample, the words of text and the letters of vocabulary (frequent words first) that a language's automata hold.
TEXT_WORDS, VOCABULARY_CHARS = 30_000, 60_000
# Languages by script, and the spellings of their labels.
SCRIPTS = {"latin": ("en", "hi"), "devanagari": ("hi", "mr", "ne"), "bengali": ("bn",)}
LABELS = {"en": ("en", "eng", "english"), "hi": ("hi", "hin", "hindi"), "bn": ("bn", "ben", "bengali", "bangla"), "ne": ("ne", "nep", "nepali"), "mr": ("mr", "mar", "marathi"), "mixed": ("mixed", "mul")}
MISSING = ("", "und", "unknown", "none", "null")
# Units that may stand in a column name of any language.
UNITS = frozenset("crore crores lakh lakhs mw mu km kwh mwh gwh ha rs inr percent per cent cumec metre meter tonne tonnes mt no nos".split())
PIECES = re.compile(r"(?<=[.।॥?!])[\"'”’)\]]*\s+|\s+/\s+|\n\s*\n")
ASCII_WORDS = re.compile(r"[a-z0-9]\w*", re.ASCII).findall  # of plain letters the same words, sooner
DEVANAGARI, BENGALI, LATIN = (re.compile(p) for p in ("[ऀ-ॣ०-ॿ]+", "[ঀ-৿]+", "[A-Za-zÀ-ɏ]+"))


class Automaton:
    """Suffix automaton of a sequence: the characters of a text, or words."""

    def __init__(self, text: Iterable):
        self.next: list[dict] = [{}]
        link, length, last = [-1], [0], 0
        for ch in text:
            cur = len(length)
            length.append(length[last] + 1)
            link.append(0)
            self.next.append({})
            p = last
            while p >= 0 and ch not in self.next[p]:
                self.next[p][ch] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][ch]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    twin = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    self.next.append(dict(self.next[q]))
                    while p >= 0 and self.next[p].get(ch) == q:
                        self.next[p][ch] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur

    def phrases(self, text: str) -> int:
        """Into how few longest matches the text falls, from left to right; a character without a match is one."""
        count, state = 0, 0
        for ch in text:
            to = self.next[state].get(ch)
            if to is None:
                count += 1
                to = self.next[0].get(ch, 0)
                if not to:
                    count += state != 0
            state = to
        return count + (state != 0)

    def cross_parse(self, words: list[str], missing: dict[str, float], most: float = math.inf) -> float:
        """Phrases of a sentence: longest runs of words, and what `missing` gives for words that are not there; `most` or more once there are that many."""
        steps, start, state, count = self.next, self.next[0], 0, 0.0
        for w in words:
            to = steps[state].get(w)
            if to is None:
                if state:
                    count += 1
                to = start.get(w, 0)
                if not to:
                    count += missing[w]
                    if count >= most:
                        return count
            state = to
        return count + (state != 0)


def script_of(text: str) -> str | None:
    """The script of most letters."""
    if text.isascii():
        return "latin" if LATIN.search(text) else None
    counts = {s: sum(map(len, p.findall(text))) for s, p in (("devanagari", DEVANAGARI), ("bengali", BENGALI), ("latin", LATIN))}
    best = max(counts, key=counts.get)
    return best if counts[best] else None


def words_of(text: str) -> list[str]:
    """The lower-case words of a text."""
    return ASCII_WORDS(text.lower()) if text.isascii() else WORDS(text.lower())


def pieces_of(text: str) -> list[str]:
    return [p for p in PIECES.split(text) if p and not p.isspace()]


class Model:
    """Word counts and automata by script and language."""

    def __init__(self, sentences: list[tuple[str, str]], rounds: int = 4):
        """sentences: language and text; the languages may be wrong in part."""
        by_script: dict[str, list[tuple[str, list[str]]]] = defaultdict(list)
        for language, text in sentences:
            script = script_of(text)
            if script and language in SCRIPTS[script]:
                by_script[script].append((language, [w for w in WORDS(text.lower()) if not w[0].isdigit()]))
        self.counts: dict[str, dict[str, Counter]] = {}
        self.texts: dict[str, dict[str, list[list[str]]]] = {}
        for script, languages in SCRIPTS.items():
            rows = by_script[script]
            names = [language for language, _ in rows]
            for _ in range(rounds + 1):
                counts = {c: Counter() for c in languages}
                for language, (_, words) in zip(names, rows, strict=True):
                    counts[language].update(words)
                if len(languages) < 2:
                    break
                totals = {c: sum(counts[c].values()) + 1.0 for c in languages}
                size = len(set().union(*counts.values())) + 1
                cost = {c: {w: math.log((n + 0.1) / (totals[c] + 0.1 * size)) for w, n in counts[c].items()} for c in languages}
                unseen = {c: math.log(0.1 / (totals[c] + 0.1 * size)) for c in languages}
                prior = {c: math.log(names.count(c) + 1) for c in languages}
                now = [max(languages, key=lambda c: prior[c] + sum(cost[c].get(w, unseen[c]) for w in words)) if len(words) > 1 else language for language, (_, words) in zip(names, rows, strict=True)]
                if now == names:
                    break
                names = now
            self.counts[script] = counts
            self.texts[script] = {c: [] for c in languages}
            left = dict.fromkeys(languages, TEXT_WORDS)
            seen: set[tuple] = set()
            for language, (_, words) in zip(names, rows, strict=True):
                if left[language] > 0 and (language, *words) not in seen:
                    seen.add((language, *words))
                    left[language] -= len(words)
                    self.texts[script][language].append(words)
        self._prepare()

    def _prepare(self) -> None:
        self.totals = {s: {c: max(1, sum(n.values())) for c, n in by.items()} for s, by in self.counts.items()}
        self.automata: dict[str, dict[str, Automaton]] = {}
        for script, by in self.counts.items():
            self.automata[script] = {}
            for language, counts in by.items():
                text, size = [], 0
                for word, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
                    if size > VOCABULARY_CHARS:
                        break
                    text.append(word)
                    size += len(word) + 1
                self.automata[script][language] = Automaton(" " + " ".join(text) + " ")
        self.missing = {s: [_Missing(self, s, i) for i in range(len(languages))] for s, languages in SCRIPTS.items()}
        self.runs = {s: [self._text(s, i) for i in range(len(languages))] for s, languages in SCRIPTS.items() if len(languages) > 1}
        self.other = _Other(self, "latin")

    def _text(self, script: str, place: int) -> Automaton:
        """The automaton of a language's text; sentences, and words of other languages in them, end its runs."""
        own: dict[str, bool] = {}
        sequence: list = []
        for words in self.texts[script][SCRIPTS[script][place]]:
            for w in words:
                if w not in own:
                    own[w] = self.word(script, w)[place] <= 1
                sequence.append(w if own[w] else None)
            sequence.append(None)
        out = Automaton(sequence)
        for step in out.next:
            step.pop(None, None)
        return out

    def __getstate__(self) -> dict:
        return {"counts": self.counts, "texts": self.texts}

    def __setstate__(self, state: dict) -> None:
        self.counts, self.texts = state["counts"], state["texts"]
        self._prepare()

    def word(self, script: str, word: str) -> list[float]:
        """Phrases of a word in each language of the script; a language too little known to judge by has one."""
        by, totals = self.counts[script], self.totals[script]
        if word[0].isdigit():
            return [0.0] * len(by)
        rates = {c: by[c][word] / totals[c] for c in by}
        most = max(rates.values())
        if not most:
            parsed = [self.automata[script][c].phrases(f" {word} ") for c in by]
            return [1 + min(1.0, 0.25 * (p - min(parsed))) for p in parsed]
        return [1.0 if rates[c] >= 0.1 * most or most * totals[c] < 3 else max(2.0, min(4.0, self.automata[script][c].phrases(f" {word} "))) for c in by]

    def judge(self, text: str, words: list[str] | None = None) -> tuple[str | None, str | None, float, int]:
        """script, language, confidence and number of words of one sentence; a language that needs twice the phrases of another is no rival."""
        script = script_of(text)
        if script is None:
            return None, None, 0.0, 0
        words = words or words_of(text)
        languages = SCRIPTS[script]
        if len(languages) == 1:
            return script, languages[0], 1.0, len(words)
        said = [w for w in words if not w[0].isdigit()]
        scores: list[float] = []
        most = math.inf
        for a, m in zip(self.runs[script], self.missing[script], strict=True):
            scores.append(a.cross_parse(said, m, most))
            most = min(most, 2 * scores[-1] + 1e-9)
        order = sorted(range(len(scores)), key=scores.__getitem__)  # ties: the first language
        first, second = scores[order[0]], scores[order[1]]
        return script, languages[order[0]], 1 - first / second if second else 0.0, len(words)


class _Missing(dict):
    """Phrases of words that the text of a language lacks."""

    def __init__(self, model: Model, script: str, place: int):
        super().__init__()
        self.model, self.script, self.place = model, script, place

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        self[word] = phrases = self.model.word(self.script, word)[self.place]
        return phrases


class _Other(dict):
    """Whether a word speaks for another language of the script than the first."""

    def __init__(self, model: Model, script: str):
        super().__init__()
        self.model, self.script = model, script

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        phrases = self.model.word(self.script, word)
        self[word] = out = min(phrases[1:]) < phrases[0] and any(n[word] for n in self.model.counts[self.script].values())
        return out


def segments_of(model: Model, text: str, least_words: int = 3) -> list[tuple[str, int, float]]:
    """Runs of sentences in one language: language, characters, confidence.

    Sentences of fewer than `least_words` words, or without a clear winner, go with their
    neighbours of the same script, or with those before them.
    """
    if text.isascii():  # without a word for another language no sentence is in one
        words = words_of(text)
        if len(words) >= least_words and not any(map(model.other.__getitem__, words)):
            _, language, sure, _ = model.judge(text, words)
            if language == SCRIPTS["latin"][0]:
                return [(language, len(text), min(1.0, 0.5 + sure))]
    judged = [(p, *model.judge(p)) for p in pieces_of(text)]
    clear: dict[str, Counter] = defaultdict(Counter)
    for p, script, language, sure, words in judged:
        if script and words >= least_words and sure > 0.02:
            clear[script][language] += len(p)
    usual = {s: c.most_common(1)[0][0] for s, c in clear.items()}
    runs: list[list] = []
    for p, script, language, sure, words in judged:
        if script is None or (words < least_words and len(judged) > 1):
            language = None
        elif sure <= 0.02:
            language = usual.get(script, language)
        if language is None:
            if runs:
                runs[-1][1] += len(p)
            continue
        sure = min(1.0, 0.5 + sure)
        if runs and runs[-1][0] == language:
            n = runs[-1][1]
            runs[-1][2] = (runs[-1][2] * n + sure * len(p)) / (n + len(p))
            runs[-1][1] += len(p)
        else:
            runs.append([language, len(p), sure])
    if not runs and judged:  # only short pieces: the text as a whole
        _, language, sure, _ = model.judge(text)
        if language:
            runs.append([language, len(text), min(1.0, 0.5 + sure)])
    return [tuple(r) for r in runs]


def name_language(model: Model, name: str) -> tuple[str | None, float]:
    """Language of a column name: mixed if parts of it (lines, brackets, sides of a slash) are in two languages."""
    parts = []
    for script_part in re.split(r"\s+/\s+|[()|\[\]]", name):
        words = WORDS(script_part.lower())
        if words and not all(w in UNITS or w[0].isdigit() for w in words):
            lines = [x for x in script_part.split("\n") if any(c.isalpha() for c in x)]
            parts += lines if len({script_of(x) for x in lines}) > 1 else [" ".join(script_part.split())]
    found: dict[str, float] = {}
    for part in parts:
        _, language, sure, _ = model.judge(part)
        if language:
            found[language] = max(found.get(language, 0.0), min(1.0, 0.5 + sure))
    if not found:
        return None, 0.0
    return ("mixed", min(found.values())) if len(found) > 1 else next(iter(found.items()))


def normal_label(label) -> F.Column:
    """A stored label as one of the languages; NULL if it is missing, itself in lower case if it is none of them."""
    low = F.substring_index(F.substring_index(F.lower(F.trim(label)), "-", 1), "_", 1)
    out = F.when(low.isin(*MISSING), F.lit(None))
    for language, spellings in LABELS.items():
        out = out.when(low.isin(*spellings), language)
    return out.otherwise(low)


def fit(blocks: DataFrame, columns: DataFrame | None = None, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model from a bounded sample of labelled rows: about `sample_rows` a label of each table, by hash."""
    sentences: list[tuple[str, str]] = []
    for df, key, text in ((columns, "column_id", "name"), (blocks, "block_id", "text")):  # names first: they are few different ones
        if df is None:
            continue
        labels = df.groupBy("language").count().select("language", normal_label(F.col("language")).alias("label"), "count")
        spelled = labels.where(F.col("label").isin("en", "hi", "bn", "ne", "mr")).collect()  # the spellings of five labels
        counts: Counter = Counter()
        for r in spelled:
            counts[r.label] += r["count"]
        take = F.lit(False)
        for label, n in sorted(counts.items()):
            take = take | (F.col("language").isin(*[r.language for r in spelled if r.label == label]) & (F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample_rows / n))))
        picked = df.where(take & F.col(text).isNotNull()).select(normal_label(F.col("language")).alias("label"), F.col(key).alias("key"), F.col(text).alias("text"))
        sample = picked.orderBy("key", "text").collect()  # at most about five times sample_rows
        for r in sample:
            sentences += [(r.label, piece) for piece in (pieces_of(r.text) if text == "text" else [r.text])]
    return Model(sentences)


_NUMBER_LINE, _BESIDE = re.compile(NUMBER_LINE), re.compile(BESIDE)


def running_text(text: str, headed: bool) -> str:
    """A block's text without its header line (if it has one) and without printed page numbers."""
    lines = text.split("\n")
    if headed:
        at = next((i for i, x in enumerate(lines) if x.strip()), 0)
        lines = lines[at + 1 :]
    return "\n".join(x for x in lines if not _NUMBER_LINE.match(x))


def block_languages(blocks: DataFrame, headers: DataFrame, model) -> DataFrame:
    """`block_id`, `doc_key`, `stored`, `language`, `confidence`, `segments`, `again` of each block with running text; where `again`, rows of the block may tie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = model.value
        kind = pa.list_(pa.struct([("language", pa.string()), ("chars", pa.int64()), ("confidence", pa.float64())]))
        for batch in batches:
            out: dict[str, list] = {"block_id": [], "doc_key": [], "stored": [], "language": [], "confidence": [], "segments": [], "again": []}
            for i, doc, stored, text, headed, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs = segments_of(judge, running_text(text, bool(headed)))
                if not runs:
                    continue
                names = {r[0] for r in runs}
                out["block_id"].append(i)
                out["again"].append(again)
                out["doc_key"].append(doc)
                out["stored"].append(stored)
                out["language"].append("mixed" if len(names) > 1 else runs[0][0])
                out["confidence"].append(min(r[2] for r in runs))
                out["segments"].append([{"language": r[0], "chars": r[1], "confidence": r[2]} for r in runs])
            yield pa.RecordBatch.from_arrays([pa.array(out["block_id"], batch.schema.field(0).type), pa.array(out["doc_key"], pa.string()), pa.array(out["stored"], pa.string()), pa.array(out["language"], pa.string()), pa.array(out["confidence"], pa.float64()), pa.array(out["segments"], kind), pa.array(out["again"], pa.bool_())], names=list(out))

    kind = blocks.schema["block_id"].dataType.simpleString()
    at = F.coalesce(F.col("loaded_at").cast("timestamp"), F.timestamp_seconds(F.lit(0)))
    times = blocks.where("block_id IS NOT NULL").groupBy("block_id").agg(F.max(at).alias("_at"), (F.count("*") > 1).alias("again"))
    facts = times.join(headers.select("block_id", F.lit(True).alias("headed")), "block_id", "left")
    rows = newest_rows(blocks, "block_id", ["doc_key", "language", "text"], facts).where("text IS NOT NULL")
    return rows.select("block_id", "doc_key", normal_label(F.col("language")).alias("stored"), "text", "headed", "again").mapInArrow(run, f"block_id {kind}, doc_key string, stored string, language string, confidence double, segments array<struct<language: string, chars: bigint, confidence: double>>, again boolean")


def column_languages(columns: DataFrame, model) -> DataFrame:
    """`column_id`, `stored`, `language`, `confidence` of each column whose name has letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = model.value
        for batch in batches:
            ids, stored, names = (c.to_pylist() for c in batch.columns)
            rows = [(i, s, *name_language(judge, n)) for i, s, n in zip(ids, stored, names, strict=True)]
            rows = [r for r in rows if r[2]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.float64()))], names=["column_id", "stored", "language", "confidence"])

    rows = newest_per_key(columns.select("column_id", "language", "name", "loaded_at").where("column_id IS NOT NULL"), ["column_id"]).where("name IS NOT NULL")
    return rows.select(F.col("column_id").cast("string"), normal_label(F.col("language")).alias("stored"), "name").mapInArrow(run, "column_id string, stored string, language string, confidence double")


def label_languages(blocks: DataFrame, columns: DataFrame, documents: DataFrame, headers: DataFrame, *, share: float = 0.75) -> DataFrame:
    """`record_level` (block, column, document, segment), `record_id`, `stored`, `language`, `confidence`.

    Of repeated keys the row loaded last counts. Blocks that are blank or hold only a header
    or page number, names without letters and documents without such blocks get no row.
    Segments are the runs of sentences of mixed blocks, counted from 1. A document's
    language has at least `share` of the characters of its blocks, else it is mixed; its
    confidence is that share.
    """
    model = blocks.sparkSession.sparkContext.broadcast(fit(blocks, columns))
    read = checkpoint(block_languages(blocks, headers, model))
    found = read.where("NOT again").unionByName(read.where("again").dropDuplicates(["block_id"]))
    cast = F.col("block_id").cast("string")
    by_block = found.select(F.lit("block").alias("record_level"), cast.alias("record_id"), "stored", "language", "confidence")
    by_column = column_languages(columns, model).select(F.lit("column").alias("record_level"), F.col("column_id").alias("record_id"), "stored", "language", "confidence")
    mixed = found.where("language = 'mixed'").select("block_id", F.posexplode("segments").alias("n", "s"))
    by_segment = mixed.select(F.lit("segment").alias("record_level"), F.concat_ws(":", cast, F.col("n") + 1).alias("record_id"), F.lit(None).cast("string").alias("stored"), F.col("s.language").alias("language"), F.col("s.confidence").alias("confidence"))
    chars = found.where("doc_key IS NOT NULL").select("doc_key", F.explode("segments").alias("s")).groupBy("doc_key", F.col("s.language").alias("language")).agg(F.sum("s.chars").alias("n"))
    top = chars.groupBy("doc_key").agg(F.max_by("language", F.struct("n", "language")).alias("top"), F.max("n").alias("most"), F.sum("n").alias("all"))
    stored = newest_per_key(documents.select("doc_key", "document_language", "loaded_at"), ["doc_key"]).select("doc_key", normal_label(F.col("document_language")).alias("stored"))
    part = F.col("most") / F.col("all")
    by_document = stored.join(top, "doc_key").select(F.lit("document").alias("record_level"), F.col("doc_key").alias("record_id"), "stored", F.when(part >= share, F.col("top")).otherwise("mixed").alias("language"), part.alias("confidence"))
    return by_block.unionByName(by_column).unionByName(by_segment).unionByName(by_document)


def wrong_labels(labels: DataFrame) -> DataFrame:
    """`record_level`, `record_id`, `language` where the stored label is missing or wrong, and of every segment."""
    return labels.where((F.col("record_level") == "segment") | F.col("stored").isNull() | (F.col("stored") != F.col("language"))).select("record_level", "record_id", "language").distinct()
