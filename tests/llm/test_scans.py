import re
import time
from collections import Counter
from itertools import product

import pyarrow as pa
import pytest

from tarkash.llm import pages, scans

WORDS = {"the": 900, "power": 120, "house": 60, "station": 200, "panel": 300, "access": 150, "road": 200, "was": 700, "closed": 90, "long-term": 40, "long": 50, "term": 45, "stage-ii": 30, "run-of-river": 20, "under": 100, "clear": 40, "dear": 30, "कार्य": 300, "and": 500}
SEEN = ["p0wer", "pane!", "closecl", "acccss", "povver", "कास्य", "elear", "aeeess", "roacl", "wäs", "c1osed"]
CHANCES = dict.fromkeys((f"{t}>{a}" for t, a in scans.CONFUSIONS), scans.CONFUSE)


def options(word):
    """The candidates of a word by trying all words."""
    if any(c in word for c in "0123456789") and not any(map(str.isalpha, word)):
        return ()
    ops = {v: scans.confused(v, word) for v in WORDS if v != word and WORDS[v] > 0}
    least = min((len(o) for o in ops.values() if o), default=0)
    return tuple(sorted((v, sum(CHANCES[x] for x in o)) for v, o in ops.items() if o and len(o) == least))


@pytest.fixture
def known():
    pairs = {"was closed": 60, "access road": 140, "the clear": 30}
    return scans.Known(WORDS | {scans.pair_key(*p.split()): n for p, n in pairs.items()}, 10_000.0, {w: options(w) for w in SEEN if options(w)}, frozenset())


@pytest.mark.parametrize(("seen", "read"), [("p0wer", "power"), ("pane!", "panel"), ("closecl", "closed"), ("acccss", "access"), ("povver", "power"), ("कास्य", "कार्य"), ("power", "power"), ("narkera", "narkera"), ("2019", "2019"), ("", "")])
def test_words(known, seen, read):
    assert known.line(["the", seen, "was"])[1] == read


def test_viterbi_equals_enumeration(known):
    tokens = ["the", "elear", "aeeess", "roacl", "wäs", "c1osed"]

    def full(path):
        before, total = "", 0.0
        for word, p in path:
            total += p + known.after(before, word)
            before = word
        return total

    best = max(product(*map(known.candidates, tokens)), key=full)
    assert known.line(tokens) == [w for w, _ in best] == ["the", "clear", "access", "road", "was", "closed"]


@pytest.mark.parametrize(("true", "seen", "ops"), [("modern", "modem", ("rn>m",)), ("clear", "dear", ("cl>d",)), ("members", "mcmbcrs", ("e>c", "e>c")), ("कार्य", "कर्य", ("ा>",)), ("same", "same", None), ("road", "rope", None), ("seen", "sccn", ("e>c", "e>c"))])
def test_confusions_and_spellings(true, seen, ops):
    assert scans.confused(true, seen) == ops
    assert ops is None or scans.spellings(true) & scans.spellings(seen)


@pytest.mark.parametrize(
    ("lines", "joined", "broken"),
    [
        (["the pow-", "er station"], ["the power", "station"], True), (["the pow- ", "  er"], ["the power"], True), (["pow\xad", "er"], ["power"], True), (["pow¬", "er"], ["power"], True),
        (["long-", "term"], ["long-term"], False), (["Stage-", "II dam"], ["Stage-II", "dam"], False), (["Narkera-", "III"], ["Narkera-III"], False), (["run-", "of-river"], ["run-of-river"], False), (["2010-", "11"], ["2010-", "11"], False), (["the -", "er"], ["the -", "er"], False), ([], [], False),
    ],
)
def test_split_words(lines, joined, broken):
    assert scans.split_words(lines, WORDS) == (joined, broken)


def test_repair(known):
    text = "Annexure to HOUSE diary 1   [3]\nThe p0wer sta-\n3\ntion was closed and the\naccess road\n- 3 -"
    assert scans.repair(text, 3, True, known) == ("The power station was closed and the access road", {"running_header", "page_number", "hyphen_break", "misread_chars"})
    assert scans.repair("3", 3, False, known) == ("", {"page_number"})
    assert scans.repair("", 3, False, known) == ("", set())
    assert scans.repair("The road was closed under 2019.", None, False, known) == ("The road was closed under 2019.", set())


def read(spark, blocks, parts=8):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    b = spark.createDataFrame(blocks, "block_id long, doc_key string, page int, seq int, kind string, text string, loaded_at timestamp").repartition(parts)
    r = spark.createDataFrame([("d", 1, "scanned"), ("d", 2, "scanned"), *((f"c{i}", 1, "digital") for i in range(1000))], "doc_key string, page int, page_type string")
    try:
        return sorted(tuple(x) for x in scans.scan_defects(b, r, b.select("block_id").limit(0)).collect()), {x.seq: x.text for x in scans.paragraphs(b, r, b.select("block_id").limit(0)).where("doc_key = 'd'").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_rare_words_seen_cleanly_stay_at_any_size(spark):
    scan = [(1, "d", 1, 1, "text", "The dear was here.", None), (2, "d", 1, 2, "text", "The elear was here.", None)]
    for n, parts in ((100, 2), (1000, 20)):
        clean = [(100 + i, f"c{i}", 1, 1, "text", "The clear was clear. The clear was here." + (" A dear." if i < 3 else ""), None) for i in range(n)]
        defects, texts = read(spark, clean + scan, parts)
        assert defects == [(2, "misread_chars")] and texts == {1: "The dear was here.", 2: "The clear was here."}


def test_a_paragraph_runs_over_pages_headers_and_numbers(spark):
    clean = [(100 + i, f"c{i}", 1, 1, "text", "The road was closed and the power station was shut.", None) for i in range(50)]
    scan = [(1, "d", 1, 1, "text", "The road was closed and the", None), (2, "d", 1, 2, "text", "- 2 -", None), (3, "d", 2, 3, "text", " \n", None), (4, "d", 2, 4, "text", "power station was shut.", None), (5, "d", 2, 5, "text", "The road was", None), (6, "d", 2, 6, "text", "closed.", None), (7, "d", 2, 7, "heading", "On the road", None), (8, "d", 2, 8, "text", "power was shut.", None)]
    for parts in (1, 40):
        assert read(spark, clean + scan, parts)[1] == {1: "The road was closed and the power station was shut.", 5: "The road was closed.", 7: "On the road", 8: "power was shut."}


def test_cases(spark):
    clean = [(100 + i, f"c{i}", 1, 1, "text", "The power station was closed and the access road was closed under the panel.", None) for i in range(400)]
    rows = [
        (1, "d", 1, 1, "text", "The p0wer station was clo-\nsed", None), (1, "d", 1, 1, "text", "The p0wer station was clo-\nsed", None), (2, "d", 1, 2, "text", "and the road was closed.", None), (3, "d", 1, 3, "text", None, None),
        (4, "d", 1, 4, "text", " \n", None), (5, "d", 2, 5, "text", "- 2 -", None), (6, "d", 3, 6, "text", "The p0wer station", None), (7, None, None, 1, "text", "The p0wer", None), (None, "d", 1, 9, "text", "The p0wer", None), (8, "d", 1, 8, "text", "The road was closed. " * 5000 + "p0wer", None),
    ]
    b = spark.createDataFrame(clean + rows, "block_id long, doc_key string, page int, seq int, kind string, text string, loaded_at timestamp")
    r = spark.createDataFrame([("d", 1, "scanned", "x"), ("d", 1, "scanned", "x"), ("d", 2, "image_based", "x"), ("d", 3, "digital", "x"), ("d", 4, None, "x"), (None, 1, "scanned", "x")], "doc_key string, page int, page_type string, text string")
    none = b.select("block_id").limit(0)
    got = {tuple(x) for x in scans.scan_defects(b, r, none).collect()}
    assert got == {(1, "misread_chars"), (1, "hyphen_break"), (5, "page_number"), (8, "misread_chars")}
    text = {(x.doc_key, x.seq): x.text for x in scans.paragraphs(b, r, none).collect()}
    assert text["d", 1] == "The power station was closed and the road was closed." and ("d", 2) not in text and ("d", 5) not in text and text["d", 6] == "The p0wer station"
    assert scans.scan_defects(b.limit(0), r.limit(0), none).count() == 0


def test_counts_of_words_and_pairs(spark):
    texts = ["The Power, the power.", "— power ( the )", "", " \n\x1c ", None, "İLK ΟΔΟΣ\u2003ΟΔΟΣ. a\x85b", "x " * 3000, "the"]
    got = scans.term_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), pairs=True).collect()
    words, twos = Counter(), Counter()
    for t in texts:
        low = [w.strip(scans.EDGES) for w in (t or "").lower().split()]
        words.update(low)
        words[""] += len(low) - low.count("")
        twos.update(scans.pair_key(a, b) for a, b in zip(low, low[1:], strict=False) if a)
    assert {r.term: r.n for r in got if r.term is not None} == words
    assert {r.pair: r.n for r in got if r.term is None} == twos  # a mark before a word does not count as the word on its own
    assert all(r.pair == scans.pair_key("", r.term) for r in got if r.term is not None)
    tally = scans.Tally(True)
    for _ in range(2):
        tally.add(pa.array(["a b", None, "", "b a"]))
    assert dict(zip(tally.numbers, tally.words.tolist(), strict=True)) == {"": 8, "a": 4, "b": 4} and tally.out().num_rows == 5


def test_time_is_linear_in_the_length_of_words():
    began = time.process_time()
    assert scans.split_words(["a" * 60_000 + " pow-", "er"], {}) == (["a" * 60_000 + " power"], True)
    assert pages.folded("v" * 30_000 + " 1-2") == "w" * 15_000 + " #"
    assert time.process_time() - began < 1


def test_numbers_in_lines_as_by_trying_every_start():
    every = re.compile(r"\S*\d[\d/.,-]*\d\S*|\b[sS]?-?\d+\b")
    for line in map("".join, product("a1 s-१/", repeat=6)):
        assert pages._NUMBERED.sub("#", line) == every.sub("#", line)
