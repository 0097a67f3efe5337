"""Repair of text from scanned pages.

Words are read through a noisy channel: each candidate for a word has the probability that
the scanner turns it into what stands there times its likelihood in the corpus (words and
pairs of neighbours). Where a line holds a word with more than one candidate, Viterbi picks
the likeliest path through the line. Before that, header lines and page numbers are taken
out and words split over two lines are joined.

All counts are whole and stay in Spark. Distinct words of scanned pages are joined with the
words of the corpus on spellings with confused characters folded together; that gives each
doubtful word its candidates, and how often each confusion occurs. Blocks then ask for what
they need by two joins (their doubtful words and the halves of split ones; then the counts
around doubtful words), so that no task holds the language model. A word that pages with
a text layer hold `CLEAN` times is never doubtful.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarkash.llm.pages import BESIDE, NUMBER_LINE
from tarkash.sources.tables import checkpoint, newest_rows, newest_times, spread, stored

#: A word's candidates occur at least this many times as often as itself.
RATIO = 50
#: A word that stands this often on pages with a text layer is taken as it is.
CLEAN = 3
#: Words above this share of the corpus (at most 1 / share of them) without candidates are not looked up.
USUAL = 2e-5
# What a scanner confuses, as true and seen characters, and how often.
CONFUSIONS = (
    ("e", "c"), ("c", "e"), ("a", "ä"), ("o", "ö"), ("u", "ü"), ("e", "é"), ("i", "|"), ("i", "1"), ("i", "!"), ("i", "l"), ("l", "i"), ("l", "1"), ("l", "!"), ("l", "|"), ("t", "†"), ("f", "t"), ("t", "f"), ("s", "5"), ("s", "$"), ("o", "0"), ("g", "9"), ("g", "q"), ("b", "6"), ("b", "8"), ("b", "h"), ("h", "b"), ("v", "y"), ("y", "v"), ("z", "2"),
    ("d", "cl"), ("cl", "d"), ("u", "ii"), ("m", "rn"), ("rn", "m"), ("in", "m"), ("m", "in"), ("h", "li"), ("li", "h"), ("w", "vv"), ("n", "ri"), ("ri", "n"), ("nn", "rm"), ("k", "lc"), ("n", "u"), ("u", "n"),
    ("र", "स"), ("स", "र"), ("व", "ब"), ("ब", "व"), ("प", "ष"), ("ष", "प"), ("ी", "ि"), ("ि", "ी"), ("ट", "ढ"), ("थ", "य"), ("य", "थ"), ("म", "भ"), ("भ", "म"), ("घ", "ध"), ("ध", "घ"), ("ड", "ड़"), ("ढ", "द"), ("द", "ढ"), ("ा", ""), ("ु", "ू"), ("ू", "ु"), ("ं", ""), ("े", "ै"), ("ै", "े"),
    ("র", "ব"), ("ব", "র"), ("য", "ষ"), ("ষ", "য"), ("ঘ", "ধ"), ("ি", "ী"), ("ী", "ি"), ("া", ""),
)
CONFUSE = math.log(0.03)
KEEP = math.log(0.95)
HYPHENS = "-‐‑¬\xad–"
ROMAN = re.compile(r"[ivxIVX]+\W*$")
EDGES = ".,;:()[]{}\"'“”‘’।॥?/*"
_HYPHENS = frozenset(HYPHENS)
_CLASS: dict[str, str] = {}
for _true, _as in CONFUSIONS:
    if len(_true) == 1 and len(_as) == 1:
        _a, _b = _CLASS.get(_true, _true), _CLASS.get(_as, _as)
        _CLASS = {k: _a if v == _b else v for k, v in (_CLASS | {_true: _a, _as: _b}).items()}
_CLASS |= {t: "" for t, a in CONFUSIONS if not a}
_FOLD = str.maketrans(_CLASS)
_RUNS = [(a, b) if len(a) >= len(b) else (b, a) for a, b in CONFUSIONS if max(len(a), len(b)) > 1]  # a run of characters and what it is confused with
_OPS: dict[str, list[tuple[str, str]]] = {}
for _true, _as in CONFUSIONS:
    _OPS.setdefault(_true[0], []).append((_true, _as))


def spellings(word: str) -> set[str]:
    """Keys of a word: its characters by class of confusion, with none and with each one of its confusable runs folded."""
    out = {word.translate(_FOLD)}
    for run, other in _RUNS:
        at = word.find(run)
        while at >= 0:
            out.add((word[:at] + other + word[at + len(run) :]).translate(_FOLD))
            at = word.find(run, at + 1)
    return out


def confused(true: str, seen: str, most: int = 2) -> tuple[str, ...] | None:
    """The fewest confusions (`true>seen`), at most `most`, that turn one word into another; None if there are none."""
    for limit in range(1, most + 1):
        stack = [(0, 0, ())]
        while stack:
            i, j, ops = stack.pop()
            if i == len(true):
                if j == len(seen) and ops:
                    return ops
                continue
            if len(ops) < limit:
                stack += [(i + len(t), j + len(a), (*ops, f"{t}>{a}")) for t, a in _OPS.get(true[i], ()) if true.startswith(t, i) and seen.startswith(a, j)]
            if j < len(seen) and true[i] == seen[j]:
                stack.append((i + 1, j + 1, ops))
    return None


_ODD, _BITS = 0x9E3779B97F4A7C15, (1 << 64) - 1


def pair_key(before: str, word: str) -> int:
    """64 bits that stand for two words in a row, or for one word (`before` empty)."""
    h = (xxhash.xxh3_64_intdigest(before) * _ODD + xxhash.xxh3_64_intdigest(word)) & _BITS
    return h - (1 << 64) if h >> 63 else h


class Known(NamedTuple):
    """What a block has to know of the corpus."""

    counts: dict  # of words, and of words and pairs of neighbours by their key
    total: float
    options: dict  # doubtful words: their candidates with the log chance of each to be seen as the word
    odd: frozenset  # words with characters that words do not have

    def single(self, word: str) -> float:
        """Log likelihood of a word on its own."""
        return math.log((self.count(word) + 0.02) / (self.total + 1))

    def count(self, word: str) -> int:
        n = self.counts.get(word)
        return self.counts.get(pair_key("", word), 0) if n is None else n

    def after(self, before: str, word: str) -> float:
        """Log likelihood of a word after another; what a doubtful word stands beside is no evidence for it."""
        n = 0 if before in self.options or word in self.options else self.count(before)
        pair = self.counts.get(pair_key(before, word), 0) / n if n else 0.0
        return math.log(0.5 * pair + 0.5 * math.exp(self.single(word)))

    def candidates(self, word: str) -> tuple[tuple[str, float], ...]:
        """Candidates of a lower-case word, the word first."""
        return ((word, KEEP), *self.options.get(word, ()))

    def line(self, tokens: list[str]) -> list[str]:
        """The likeliest reading of lower-case tokens (Viterbi)."""
        if self.options.keys().isdisjoint(tokens):
            return tokens
        best: dict[str, tuple[float, list[str]]] = {"": (0.0, [])}
        for t in tokens:
            o = self.candidates(t)
            if len(o) == 1 and len(best) == 1:
                [(score, path)] = best.values()
                best = {t: (score, [*path, t])}
            else:
                best = {c: max((s + p + self.after(b, c), [*path, c]) for b, (s, path) in best.items()) for c, p in o}
        return max(best.values())[1]

    def around(self, tokens: list[str]) -> set[int]:
        """The keys of words and pairs whose counts `line` asks for."""
        keys: set[int] = set()
        for a, b in zip(["", *tokens], tokens, strict=False):
            if a in self.options or b in self.options:
                left, right = ([c for c, _ in self.options.get(x, ((x, 0.0),))] for x in (a, b))
                keys.update(pair_key("", x) for x in (*left, *right) if x and x not in self.counts)
                keys.update(pair_key(x, y) for x in left if x for y in right)
        return keys


def split_end(line: str) -> tuple[str, str, int] | None:
    """What stands before a hyphen that ends a line, the hyphen, and where the word starts; None if there is none."""
    line = line.rstrip(" \t\r")
    if line[-1:] not in _HYPHENS:
        return None
    last = line.rsplit(None, 1)[-1]
    return last[:-1], last[-1], len(line) - len(last)


def split_words(lines: list[str], words: dict) -> tuple[list[str], bool]:
    """The lines with words split over two of them joined, and whether there was one.

    A hyphen stays where the word is written with it: where the corpus has it so, or has it
    so more often than without, or the second half is a Roman number.
    """
    out: list[str] = []
    broken = False
    for line in lines:
        last = split_end(out[-1]) if out else None
        first = line.lstrip().split(" ", 1) if last else [""]
        if last and last[0] and first[0][:1].isalpha() and last[0][-1].isalpha():
            left, right = last[0], first[0]
            a = left.strip(EDGES).lower()
            b = right.rstrip(EDGES).lower()
            whole, compound = words.get(a + b, 0), max(words.get(f"{a}-{b}", 0), words.get(f"{a}-{b.split('-')[0]}", 0))
            soft = last[1] in "\xad¬"
            stays = not soft and (compound > whole or (not whole and (ROMAN.match(right) or (right[0].isupper() and words.get(b, 0)) or (words.get(a, 0) and words.get(b, 0) and "-" in a))))
            if not stays:
                broken = True
            out[-1] = out[-1][: last[2]] + left + ("-" if stays else "") + right
            if len(first) > 1:
                out.append(first[1])
        else:
            out.append(line)
    return out, broken


_NUMBER_LINE, _BESIDE, _PLAIN = re.compile(NUMBER_LINE), re.compile(BESIDE), re.compile(r"\s*\d+\s*$")


def body_of(text: str, page: int | None, headed: bool) -> tuple[list[str], set[str]]:
    """The lines of a block without header and page numbers, and which of these it held."""
    defects: set[str] = set()
    lines = [x.rstrip("\r") for x in text.split("\n")]
    if headed:
        at = next((i for i, x in enumerate(lines) if x.strip()), 0)
        defects.add("running_header")
        if _BESIDE.search(lines[at]):
            defects.add("page_number")
        del lines[at]
    body = []
    alone = sum(bool(x.strip()) for x in lines) == 1
    for x in lines:
        if _NUMBER_LINE.match(x) and (alone or not _PLAIN.match(x) or page is None or int(x) == page):
            defects.add("page_number")
        else:
            body.append(x)
    return body, defects


def asked(body: list[str], plain: frozenset) -> tuple[set[str], set[str]]:
    """The words of the lines other than `plain` ones, and what tells whether words split over them are one."""
    words = {w.strip(EDGES) for w in set("\n".join(body).lower().split()) - plain}
    halves: set[str] = set()
    for i, (line, after) in enumerate(zip(body, body[1:], strict=False)):
        last = split_end(line)
        first = after.lower().split(None, 1) if last else None
        if last and last[0] and first:
            a, b = last[0].strip(EDGES).lower(), first[0].strip(EDGES)
            c = b.rstrip(HYPHENS)
            halves |= {a, b, a + b, f"{a}-{b}", f"{a}-{b.split('-')[0]}", a + c, c}
            words |= {a + b, f"{a}-{b}", a + c}
            if len(first) == 1 and split_end(after) and i + 2 < len(body) and body[i + 2].strip():  # a word over three lines
                d = body[i + 2].lower().split(None, 1)[0].strip(EDGES)
                halves |= {a + c + d, f"{a + c}-{d}", d}
                words.add(a + c + d)
    return words - plain - {""}, halves - {""}


def repair(text: str, page: int | None, headed: bool, known: Known, texts: bool = True) -> tuple[str, set[str]]:
    """The readable text of a block (if `texts`) and its defects."""
    body, defects = body_of(text, page, headed)
    joined, broken = split_words(body, known.counts)
    if broken:
        defects.add("hyphen_break")
    doubtful = known.options.keys() | known.odd
    out = []
    for line in joined:
        held = doubtful and line.lower()
        if held and any(w in held for w in doubtful):
            words = line.split()
            bare = [w.strip(EDGES) for w in words]
            low = [w.lower() for w in bare]
            if not doubtful.isdisjoint(low):
                for i, (was, now) in enumerate(zip(low, known.line(low), strict=True)):
                    if now != was:
                        defects.add("misread_chars")
                        if bare[i].isupper() and len(bare[i]) > 1:
                            now = now.upper()
                        elif bare[i][:1].isupper():
                            now = now[:1].upper() + now[1:]
                        words[i] = words[i].replace(bare[i], now)
                    elif was in known.odd:
                        defects.add("misread_chars")
            out.append(" ".join(words))
        elif texts:
            out.append(" ".join(line.split()))
    return " ".join(x for x in out if x), defects


class Tally:
    """Counts of words (lower case, without marks at their edges) and of pairs of neighbours; words stand by number."""

    def __init__(self, pairs: bool):
        self.pairs = pairs
        self.numbers: dict[str, int] = {"": 0}  # of words
        self.seen: dict[str, int] = {}  # the numbers of words as they are written
        self.words = np.zeros(1, np.int64)
        self.twos: list[np.ndarray] = []  # both numbers of a pair in 64 bits
        self.held = 0

    def add(self, texts: pa.Array) -> None:
        """Arrow and Python agree on blanks; a word in lower case is the same with and without its text."""
        texts = pc.utf8_trim_whitespace(texts)
        parts = pc.utf8_split_whitespace(texts.filter(pc.greater(pc.binary_length(texts), 0)))
        coded = parts.flatten().dictionary_encode()
        if not len(coded):
            return
        seen, numbers = self.seen, self.numbers
        written = coded.dictionary.to_pylist()
        for w in written:
            if w not in seen:
                seen[w] = numbers.setdefault(w.lower().strip(EDGES), len(numbers))
        at = np.fromiter(map(seen.__getitem__, written), np.int64, len(written))[coded.indices.to_numpy()]
        words = np.bincount(at, minlength=len(numbers))
        words[: len(self.words)] += self.words
        words[0] += len(at) - np.count_nonzero(at == 0)  # the empty word has the number of all words
        self.words = words
        if self.pairs:
            inside = np.ones(len(at) - 1, bool)
            inside[np.cumsum(pc.list_value_length(parts).to_numpy())[:-1] - 1] = False
            inside &= at[:-1] != 0  # a mark on its own is no word before another
            self.twos.append((at[:-1] << 32 | at[1:])[inside])
            self.held += len(at)

    def out(self) -> pa.RecordBatch:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, self.numbers), np.uint64, len(self.numbers))
        twos, n = np.unique(np.concatenate(self.twos) if self.twos else np.zeros(0, np.int64), return_counts=True)
        keys = np.concatenate([h[:1] * np.uint64(_ODD) + h, h[twos >> 32] * np.uint64(_ODD) + h[twos & 0xFFFFFFFF]]).view(np.int64)
        terms = pa.concat_arrays([pa.array(self.numbers, pa.string()), pa.nulls(len(twos), pa.string())])
        return pa.RecordBatch.from_arrays([terms, pa.array(keys), pa.array(np.concatenate([self.words, n]))], names=["term", "pair", "n"])


def term_counts(texts: DataFrame, pairs: bool, most: int = 4_000_000) -> DataFrame:
    """`term`, `pair` (a key), `n`: how often each word (lower case, without marks at its edges) and, if `pairs`, each pair of neighbours (term NULL) occurs in column `text`; the empty term has the number of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(pairs)
        for batch in batches:
            tally.add(batch.column(0))
            if tally.held > most or len(tally.seen) > most // 8:
                yield tally.out()
                tally = Tally(pairs)
        yield tally.out()

    return texts.select("text").mapInArrow(count, "term string, pair bigint, n bigint").groupBy("term", "pair").agg(F.sum("n").alias("n"))


def _keyed(words: DataFrame, column: str) -> DataFrame:
    """`words` with a row for each spelling `key` of the column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [spellings(w) for w in batch.column(column).to_pylist()]
            at = pa.array([i for i, k in enumerate(keys) for _ in k], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array([k for ks in keys for k in ks], pa.string())], names=[*batch.schema.names, "key"])

    return words.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in words.dtypes) + ", key string")


def _aligned(pairs: DataFrame) -> DataFrame:
    """Of (word, n, other, m) those that confusions explain, with these: `ops`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ops = [confused(v, w) for w, v in zip(batch.column("word").to_pylist(), batch.column("other").to_pylist(), strict=True)]
            kept = pa.array([o is not None for o in ops], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(c.filter(kept) for c in batch.columns), pa.array([list(o) for o in ops if o is not None], pa.list_(pa.string()))], names=[*batch.schema.names, "ops"])

    return pairs.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in pairs.dtypes) + ", ops array<string>")


def is_odd(word, clean) -> Column:
    """Whether a word holds characters that words and numbers do not have."""
    strange = word.rlike(r"[†¦]|[a-z]\||\|[a-z]|^(?:\d+[bolisg]\d+$|\d{2,}[bolis]$|[bolis]\d{2,}$)") | ((clean < CLEAN) & word.rlike(r"[a-z][|†¦0-9!][a-z]"))
    return strange & ~word.contains("/") & ~word.contains("@")


def doubtful_words(words: DataFrame) -> DataFrame:
    """`word`, `options` (other, m, ops) of the words that may be misread, from `word`, `n`, `clean` and `scanned` counts.

    Candidates are `RATIO` times as frequent and one or two confusions away; where one
    confusion explains the word, those of two are left out.
    """
    word = F.col("word")
    asks = words.where((F.col("scanned") > 0) & (F.col("clean") < CLEAN) & ((F.length(word) > 2) | ((F.length(word) == 2) & ~word.rlike(r"^\p{L}+$"))) & word.rlike(r"\p{L}")).select("word", "n")
    gives = words.where(F.col("n") > RATIO).select(F.col("word").alias("other"), F.col("n").alias("m"))  # no word is rarer than once
    met = _keyed(asks, "word").join(_keyed(gives, "other"), "key").where((F.col("m") > RATIO * F.col("n")) & (F.col("word") != F.col("other"))).select("word", "n", "other", "m").distinct()
    found = _aligned(met).groupBy("word").agg(F.collect_list(F.struct("other", "m", "ops")).alias("o"), F.min(F.size("ops")).alias("least"))
    return found.select("word", F.filter("o", lambda x: F.size(x["ops"]) == F.col("least")).alias("options"))


def channel(doubtful: DataFrame, words: DataFrame) -> dict[str, float]:
    """Log chance of each confusion, from how often the doubtful words with one candidate show it; a few dozen rows.

    A confusion of mean frequency has the chance 0.03; none is more than five times rarer or more frequent.
    """
    trues = list(dict.fromkeys(t for t, _ in CONFUSIONS))

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(trues), np.int64)
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False)
            sums += [int(pc.count_substring(batch.column(0), t).to_numpy() @ n) for t in trues]
        yield pa.RecordBatch.from_arrays([pa.array(trues), pa.array(sums)], names=["true", "n"])

    there = words.where("scanned > 0").select("word", "scanned").mapInArrow(spots, "true string, n bigint")
    held = {r.true: float(r.n or 0) for r in there.groupBy("true").agg(F.sum("n").alias("n")).collect()}
    one = doubtful.where(F.size("options") == 1).select(F.explode(F.col("options")[0]["ops"]).alias("op")).groupBy("op").count().collect()
    rates = {r.op: r["count"] / max(1.0, held.get(r.op.split(">")[0], 0.0)) for r in one}
    mean = sum(rates.values()) / len(rates) if rates else 1.0
    return {f"{t}>{a}": CONFUSE + max(-math.log(5), min(math.log(5), math.log(rates.get(f"{t}>{a}", 0) / mean + 1e-9))) for t, a in CONFUSIONS}


def _postings(rows: DataFrame, usual, most: int = 1_000_000) -> DataFrame:
    """`term`, `use`, `blocks`: which blocks ask for a word, as one that may be misread (`word`) or for halves of a split one (`half`), and which have a defect whatever the answer (`defect`)."""

    def out(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in held], pa.string()), pa.array([u for _, u in held], pa.string()), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["term", "use", "blocks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, n, held = usual.value, 0, {}
        for batch in batches:
            for i, text, page, headed in zip(*(batch.column(c).to_pylist() for c in ("n", "text", "page", "headed")), strict=True):
                body, defects = body_of(text, page, headed)
                words, halves = asked(body, plain)
                if halves and split_words(body, {})[1]:  # where the corpus knows neither half
                    defects.add("hyphen_break")
                for use, terms in (("word", words), ("half", halves), ("defect", defects)):
                    for t in terms:
                        held.setdefault((t, use), []).append(i)
                        n += 1
                if n > most:
                    yield out(held)
                    n, held = 0, {}
        yield out(held)

    return rows.select("n", "text", "page", "headed").mapInArrow(run, "term string, use string, blocks array<bigint>")


def _parts(column: pa.Array) -> tuple[list[range], list[pa.Array]]:
    """Where the structs of each list of a column are, and their fields, all lists in a row."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
    return [range(i, j) for i, j in zip([0, *ends], ends, strict=False)], column.flatten().flatten()


def _knowns(facts: pa.Array, around: pa.Array | None, total: float, chances: dict[str, float]) -> Iterator[Known | None]:
    """What each block knows; None for one without facts."""
    blocks, (terms, ns, odds, choices) = _parts(facts)
    spans, (others, ms, ops) = _parts(choices)
    lengths, ops = pc.list_value_length(ops).to_pylist(), iter(ops.flatten().to_pylist())
    others = list(zip(others.to_pylist(), ms.to_pylist(), [sum(chances[next(ops)] for _ in range(n)) for n in lengths], strict=True))
    terms, ns, odds = terms.to_pylist(), ns.to_pylist(), odds.to_pylist()
    beside, (pairs, twos) = _parts(around) if around is not None else ([range(0)] * len(blocks), (pa.array([]), pa.array([])))
    pairs, twos = pairs.to_pylist(), twos.to_pylist()
    for block, near in zip(blocks, beside, strict=True):
        if not block:
            yield None
            continue
        counts, options, odd = {}, {}, set()
        for i in block:
            if ns[i] is not None:
                counts[terms[i]] = ns[i]
            if odds[i]:
                odd.add(terms[i])
            if spans[i]:
                found = others[spans[i].start : spans[i].stop]
                counts |= {o: m for o, m, _ in found}
                options[terms[i]] = tuple(sorted((o, p) for o, _, p in found))
        counts.update(zip(pairs[near.start : near.stop], twos[near.start : near.stop], strict=True))
        yield Known(counts, total, options, frozenset(odd))


def _around(rows: DataFrame, model) -> DataFrame:
    """`n`, `pair`: the counts, by key, that blocks with doubtful words ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, text, page, headed, known in zip(*(batch.column(c).to_pylist() for c in ("n", "text", "page", "headed")), _knowns(batch.column("facts"), None, *model.value), strict=True):
                wanted: set[int] = set()
                for line in split_words(body_of(text, page, headed)[0], known.counts)[0]:
                    low = line.lower()
                    if not any(w in low for w in known.options):
                        continue
                    tokens = [w.strip(EDGES) for w in low.split()]
                    if not known.options.keys().isdisjoint(tokens):
                        wanted |= known.around(tokens)
                ids += [i] * len(wanted)
                keys += wanted
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64())], names=["n", "pair"])

    return rows.select("n", "text", "page", "headed", "facts").mapInArrow(run, "n bigint, pair bigint")


def _repaired(rows: DataFrame, model, texts: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = Known({}, model.value[0], {}, frozenset())
        for batch in batches:
            known = _knowns(batch.column("facts"), batch.column("around"), *model.value)
            done = [repair(t, p, h, k or plain, texts) for t, p, h, k in zip(*(batch.column(c).to_pylist() for c in ("text", "page", "headed")), known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("n"), pa.array([d[0] if texts else None for d in done], pa.string()), pa.array([sorted(d[1]) for d in done], pa.list_(pa.string()))], names=["n", "repaired", "defects"])

    return rows.select("n", "text", "page", "headed", "facts", "around").mapInArrow(run, "n bigint, repaired string, defects array<string>")


def _rows(blocks: DataFrame, routes: DataFrame, headers: DataFrame) -> DataFrame:
    """All rows of blocks on pages that are not known to have a text layer.

    `scanned` says that the page is scanned or image_based, `headed` that a header opens
    the block, `newest` that no row of the block was loaded later.
    """
    kind = F.col("page_type")
    types = routes.where("doc_key IS NOT NULL AND page IS NOT NULL").groupBy("doc_key", "page").agg(F.max(kind.isin("scanned", "image_based")).alias("scanned"), F.min(F.coalesce(kind == "digital", F.lit(False))).alias("digital"))
    at = F.coalesce(F.col("loaded_at").cast("timestamp"), F.timestamp_seconds(F.lit(0)))
    keys = blocks.where("block_id IS NOT NULL").groupBy("block_id").agg(F.max(at).alias("_at"), F.max_by(F.struct("doc_key", "page"), at).alias("k")).select("block_id", "_at", "k.*")
    facts = keys.join(types, ["doc_key", "page"], "left").where("NOT coalesce(digital, false)").join(headers.select("block_id", F.lit(True).alias("headed")), "block_id", "left")
    facts = facts.select("block_id", "_at", "doc_key", "page", F.coalesce("scanned", F.lit(False)).alias("scanned"), F.coalesce("headed", F.lit(False)).alias("headed"))
    wide = blocks.select("block_id", at.alias("_mine"), "seq", "kind", "text")
    return wide.join(facts.hint("shuffle_hash"), "block_id").where("text IS NOT NULL").select("block_id", "doc_key", "page", "seq", "kind", "text", "scanned", "headed", (F.col("_mine") == F.col("_at")).alias("newest"))


def _read(blocks: DataFrame, routes: DataFrame, headers: DataFrame, texts: bool = True) -> tuple[DataFrame, DataFrame]:
    """The blocks on scanned pages (`n` stands for their id) and what is read in them: `n`, `repaired` (if `texts`), `defects`; without texts only of blocks that have any."""
    spark = blocks.sparkSession
    whole_numbers = blocks.schema["block_id"].dataType.simpleString() in ("bigint", "int", "smallint")
    rows = stored(_rows(blocks, routes, headers).withColumn("n", F.col("block_id").cast("bigint") if whole_numbers else F.xxhash64("block_id")))
    whole = term_counts(spread(blocks.where("text IS NOT NULL").select("block_id", "text"), "block_id"), pairs=True)
    dim = term_counts(rows, pairs=False).where("term <> ''").select("term", F.col("n").alias("dim"))
    counts = stored(whole.where("term IS NOT NULL OR n > 1"))  # a pair seen once is no evidence
    total = float(counts.where("term = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])  # one number
    words = counts.where("term <> ''").join(dim, "term", "left").select(F.col("term").alias("word"), "n", F.coalesce("dim", F.lit(0)).alias("scanned"), (F.col("n") - F.coalesce("dim", F.lit(0))).alias("clean"))
    words = checkpoint(words)
    doubtful = checkpoint(doubtful_words(words))
    model = spark.sparkContext.broadcast((total, channel(doubtful, words)))
    told = words.join(doubtful, "word", "left").select(F.col("word").alias("term"), "n", ((F.col("scanned") > 0) & is_odd(F.col("word"), F.col("clean"))).alias("odd"), "options")
    usual = told.where((F.col("n") >= USUAL * total) & ~F.col("odd") & F.col("options").isNull()).select("term").collect()  # at most 1 / USUAL words
    scanned = rows.where("scanned AND newest").select("n", "text", "page", "headed")
    asks = stored(_postings(scanned, spark.sparkContext.broadcast(frozenset(r.term for r in usual))))
    met = asks.where("use <> 'defect'").join(told, "term").where("use = 'half' OR odd OR options IS NOT NULL")
    word = F.col("use") == "word"
    facts = met.select(F.explode("blocks").alias("n_"), F.struct("term", "n", F.when(word, F.col("odd")).alias("odd"), F.when(word, F.col("options")).alias("options")).alias("f"))
    facts = checkpoint(facts.groupBy(F.col("n_").alias("n")).agg(F.collect_list("f").alias("facts")))  # a block's words
    asking = scanned.join(facts, "n", "left" if texts else "inner")
    wanted = _around(asking.where("exists(facts, f -> size(f.options) > 0)"), model)
    around = wanted.join(counts.select("pair", F.col("n").alias("m")), "pair").groupBy("n").agg(F.collect_list(F.struct("pair", F.col("m").alias("n"))).alias("around"))
    read = _repaired(asking.join(around, "n", "left"), model, texts)
    if texts:
        return rows, read
    sure = asks.where("use = 'defect'").select(F.explode("blocks").alias("n"), "term").join(facts.select("n"), "n", "left_anti").groupBy("n").agg(F.collect_set("term").alias("defects"))  # blocks that ask for nothing
    return rows, read.select("n", "defects").unionByName(sure)


def scan_defects(blocks: DataFrame, routes: DataFrame, headers: DataFrame) -> DataFrame:
    """`block_id`, `defect`: one row per block on a scanned page and defect.

    Defects: hyphen_break, misread_chars, running_header, page_number. Of repeated ids the
    row loaded last counts; NULL and blank texts and pages without a type have no defect.
    """
    rows, read = _read(blocks, routes, headers, texts=False)
    found = read.where(F.size("defects") > 0).select("n", F.explode("defects").alias("defect"))
    kind = blocks.schema["block_id"].dataType.simpleString()
    if kind in ("bigint", "int", "smallint"):
        return found.select(F.col("n").cast(kind).alias("block_id"), "defect").distinct()
    return rows.select("n", "block_id").distinct().join(found, "n").select("block_id", "defect").distinct()


_CLOSED, _GOES_ON = re.compile(r"[.।?!:]\W*$"), re.compile(r"[a-zß-öø-ÿ]|[ऀ-৿]")


def _open(before: str, kind: str | None, text: str) -> bool:
    """Whether a text goes on in the next block's text."""
    return kind != "heading" and not _CLOSED.search(before) and bool(_GOES_ON.match(text))


def _flow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in reading order as paragraphs; the first and the last of a range are marked as its edges."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = ["doc_key", "seq", "blocks", "text", "kind", "part", "edge"]
    now: list | None = None
    first = True

    def out(rows: list) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    for batch in batches:
        done = []
        for doc, seq, kind, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if now and now[0] == doc and doc is not None and _open(now[3][-1], now[4], text):
                now[3].append(text)
                now[2] += 1
                now[4] = kind
            else:
                if now:
                    done.append([*now[:3], " ".join(now[3]), now[4], part, 0 if first else None])
                    first = False
                now = [doc, seq, 1, [text], kind]
        if done:
            yield out(done)
    if now:
        yield out([[*now[:3], " ".join(now[3]), now[4], part, 0 if first else 1]])


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges in order, those that go on in the next one joined; one or two a range."""
    now: list | None = None
    done = []
    for batch in batches:
        for doc, seq, blocks, text, kind, part in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if now and now[0] == doc and doc is not None and now[5] != part and _open(now[3], now[4], text):
                now = [doc, now[1], now[2] + blocks, f"{now[3]} {text}", kind, part]
            else:
                done += [now] if now else []
                now = [doc, seq, blocks, text, kind, part]
    done += [now] if now else []
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["doc_key", "seq", "blocks", "text"])


def paragraphs(blocks: DataFrame, routes: DataFrame, headers: DataFrame) -> DataFrame:
    """`doc_key`, `seq`, `blocks`, `text`: the paragraphs of each document in reading order.

    `seq` is that of the paragraph's first block, `blocks` how many it runs over: a sentence
    that no mark closes goes on in the next block with text, over page breaks, headers and
    page numbers, if that starts in lower case (or in a script without case). Headers and
    page numbers are gone, blank blocks left out; blocks of pages that are not scanned come
    as they are, with lines joined. Ranges of blocks in order are read one by one, so no
    document has to fit a task; the edges of the ranges are joined afterwards.
    """
    rows, read = _read(blocks, routes, headers)
    repaired = rows.where("scanned AND newest").join(read, "n").select("block_id", "doc_key", "seq", "kind", F.col("repaired").alias("text"))
    other = newest_rows(blocks, "block_id", ["doc_key", "seq", "kind", "text"], newest_times(blocks, "block_id")).where("text IS NOT NULL").join(rows.where("scanned").select("block_id"), "block_id", "left_anti")
    texts = repaired.unionByName(other).withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).where("text <> ''").dropDuplicates(["block_id"])
    texts = stored(texts)
    order = ["doc_key", "seq", "block_id"]
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flow = stored(texts.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_key", "seq", "kind", "text").mapInArrow(_flow, "doc_key string, seq int, blocks int, text string, kind string, part int, edge int"))
    inside = flow.where("edge IS NULL").select("doc_key", "seq", "blocks", "text")
    edges = flow.where("edge IS NOT NULL").repartition(1).sortWithinPartitions("part", "edge")  # at most two a range
    return inside.unionByName(edges.select("doc_key", "seq", "blocks", "text", "kind", "part").mapInArrow(_stitch, "doc_key string, seq int, blocks int, text string"))
