import math
import random
import time
from itertools import combinations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tarkash.llm import persons
from tarkash.llm.persons import Span
from tarkash.sources import read_table


@pytest.fixture(scope="module")
def field(spark):
    return persons.fit(read_table(spark, "/root/testdata/sf0.1", "documents"), sample=2500)


spans = st.lists(st.tuples(st.integers(0, 12), st.integers(1, 5), st.integers(-20, 20)), max_size=7)


@given(spans)
def test_dynamic_programme_equals_enumeration(rows):
    rows = sorted({(a, a + n): w / 10 for a, n, w in rows}.items())
    items, scores = [Span(a, b, "name") for (a, b), _ in rows], [w for _, w in rows]
    free = [c for k in range(len(items) + 1) for c in combinations(range(len(items)), k) if all(items[i].end <= items[j].start or items[j].end <= items[i].start for i, j in combinations(c, 2))]
    total, prob = persons.marginals(items, scores)
    weights = [math.exp(sum(scores[i] for i in c)) for c in free]
    assert math.isclose(total, math.log(sum(weights)), abs_tol=1e-9)
    for i in range(len(items)):
        assert math.isclose(prob[i], sum(w for w, c in zip(weights, free, strict=True) if i in c) / sum(weights), abs_tol=1e-9)
    best = persons.best_choice(items, scores)
    assert math.isclose(sum(scores[items.index(s)] for s in best), max(sum(scores[i] for i in c) for c in free), abs_tol=1e-9)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Kindly write to a.kantelu@post.example or call +91 98450 12345 before noon.", {("email", "a.kantelu@post.example"), ("phone", "+91 98450 12345")}),
        ("Rate @ 12 per cent. The handle @Bulletin carried it. Batch 2354003579 of cement failed.", set()),
        ("Material code 48217731129 was returned. Voucher 2527-134-6890 stands cancelled.", set()),
        ("Tel: (01996) 249092\nWhatsapp ४६६५८ ४११४५ only.", {("phone", "(01996) 249092"), ("phone", "४६६५८ ४११४५")}),
        ("Mr. Delvan Kantelu (card no. 1259 1683 8997) has claimed compensation.", {("name", "Delvan Kantelu"), ("id_number", "1259 1683 8997")}),
        ("Shri Pralok Jhelbat spoke first; later Mr. Jhelbat sought the map.", {("name", "Pralok Jhelbat"), ("name", "Jhelbat")}),
        ("Correspondence should be sent to H. No. 28/4, Mill Street, Ward 12, Quorrura - 013794.", {("address", "H. No. 28/4, Mill Street, Ward 12, Quorrura - 013794")}),
        ("श्री एकलिसा कांतेलु ने शिकायत भेजी है।", {("name", "एकलिसा कांतेलु")}),
        ("The Sothmuwar Committee met in Room 19. The access road between Kalkepal and Narkera was closed.", set()),
    ],
)
def test_mentions(field, text, found):
    assert {(s.kind, text[s.start : s.end]) for s in field.find(text)} == found


def test_cases(spark, field):
    text = "प्र 🙂 call +91 98450 12345 now"
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", None), (4, text, "x"), (4, text, "x"), (None, text, "x"), (5, "word " * 100_000 + text, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    shared = spark.sparkContext.broadcast(field)
    got = persons.mentions(df, shared).collect()
    assert sorted((r.doc_id, r.kind, r.start_pos) for r in got) == [(4, "phone", text.index("+")), (4, "phone", text.index("+")), (5, "phone", 500_000 + text.index("+"))]
    clean = {r.doc_id: r.text for r in persons.redacted(df, shared).collect()}
    assert clean[1] is None and clean[2] == "" and clean[3] == " \n" and clean[4] == "प्र 🙂 call [PHONE] now"
    assert persons.mentions(df.limit(0), shared).count() == 0
    assert persons.fit(df.limit(0)).find(text) is not None


def test_name_words_come_from_all_documents(spark):
    letters = "bdfgklmnprstvz"
    names = [f"{a.upper()}o{b}e{c}u" for a in letters for b in letters for c in letters[:2]]
    rows = [(i, f"Shri {w}k {w}s, spoke first. The map was late.") for i, w in enumerate(names)]
    field = persons.fit(spark.createDataFrame(rows, "doc_id long, text string"), sample=40)
    assert {f"{w}k" for w in names} <= field.words.given and {f"{w}s" for w in names} <= field.words.family
    assert "late" in field.words.common and persons.lexicon_of({("lower", "kantelu"): 3, ("family", "Kantelu"): 40}).family == {"Kantelu"}


def test_long_spans_and_addresses_without_a_code():
    road = "House No. 12, " + "Very Long Name Of A Road, " * 12 + "Town 123456"
    mail = "x@" + "a" * 300 + ".org"
    for text, kind, body in ((f"A resident of {road}, wrote.", "address", road), (f"Write to {mail} today", "email", mail), ("He is a resident of House No. 12, Canal Road, Okhpikot and has applied.", "address", "House No. 12, Canal Road, Okhpikot")):
        assert (kind, body) in {(s.kind, text[s.start : s.end]) for s in persons.candidates(text)}
    assert not persons.candidates("House No. 12. The road, the dam, the bridge. Code 123456")


PIECES = ["House No. ", "H. No. ", "Plot No. #", "Vill. ", "C/o ", "12/3, ", "#A-12B, ", "1/2/3, ", "-7, ", "A", "Kumar", "McDonald", "a", "b.", "@", " @ ", "(at)", "[ at ]", " (dot) ", "x.y", "+91 ", "(01996) ", "98450 12345", "123 456", "-123456", "४६६५८ ४११४५", "AB-12 1234567", "ABC1234567", "P.K. ", "Mrs. ", "Shri ", "Adv ", "and ", "told by ", "nominee is ", "officer: ", "Regards,\n", "Sd/-\n(", "S/o ", "Name: ", "applicant ", " was ", "(", ")", ".", ",", " ", "\n", "\t", "/", "-", "é", "मकान ", "²", "0", "1", "_", "%"]


def test_places_tried_hold_all_matches():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choices(PIECES, k=rng.randint(1, 14)))
        cues = persons._cue_places(text)
        for pattern, found in ((persons.ADDRESS, persons._addresses(text)), (persons.CODE, persons._codes(text)), *((p, persons._tried(p, text, cues)) for p in (persons.NAME_CUE, persons.FRAMES))):
            assert [m.span() for m in found] == [m.span() for m in pattern.finditer(text)], text
        long = [m.span() for m in persons.NUMBER.finditer(text) if sum(map(str.isdigit, m.group())) >= 8]
        assert [m.span() for m in persons._numbers(text) if sum(map(str.isdigit, m.group())) >= 8] == long, text
        assert persons.without_emails(text) == persons.EMAIL.sub(" ", text), text


def test_time_is_linear_in_the_length_of_words():
    began = time.process_time()
    assert set(persons.word_counts("a" * 60_000 + " call b@c.de")) == {("lower", "a" * 60_000), ("lower", "call")}
    assert time.process_time() - began < 1
