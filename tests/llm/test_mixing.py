import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tarkash.llm import mixing
from tarkash.sources import read_table

cell = st.tuples(st.sampled_from("abc"), st.sampled_from(["en", "hi"]), st.sampled_from("xy"))


@settings(deadline=None)
@given(st.dictionaries(cell, st.floats(1, 1000), min_size=1), st.tuples(*[st.integers(1, 4)] * 3), st.tuples(*[st.floats(0.05, 1)] * 3))
def test_raking_meets_targets_within_caps(cells, caps, shares):
    caps, shares = dict(zip("abc", map(float, caps), strict=True)), dict(zip("abc", shares, strict=True))
    weight, total = mixing.rake(cells, caps, shares)
    live = {c[0] for c in cells}
    whole = sum(shares[s] for s in live)
    for s in live:
        reached = sum(w * cells[c] for c, w in weight.items() if c[0] == s)
        assert abs(reached - total * shares[s] / whole) <= 1e-6 * total
    assert all(0 <= w <= caps[c[0]] + 1e-9 for c, w in weight.items())


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(1, 500), st.floats(0, 3)), max_size=60))
def test_dealt_tokens_come_near_those_owed(rows):
    tokens, weight = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    uses = mixing.deal(tokens, weight)
    assert all(np.floor(w) <= u <= np.ceil(w) for u, w in zip(uses, weight, strict=True))
    assert abs((uses * tokens).sum() - (weight * tokens).sum()) <= max(tokens, default=0) / 2 + 1e-6


def test_shares_of_a_small_pool(spark):
    d, t, p = (read_table(spark, "/root/testdata/sf0.01", x) for x in ("documents", "source_targets", "parsed"))
    mixed = mixing.mix(d, t, p)
    got = mixing.shares(mixed, t).collect()
    used = sum(r.target_share for r in got if r.tokens)
    assert all(abs(r.actual_share - r.target_share / used) < 0.002 for r in got if r.tokens)
    axes = mixing.axis_shares(d, mixed, t, p).collect()
    assert {r.axis for r in axes} == {"lang", "topic"} and all(abs(sum(r.actual_share for r in axes if r.axis == a) - 1) < 1e-9 for a in ("lang", "topic"))


def test_table(spark):
    d, t, p = (read_table(spark, "/root/testdata/sf0.1", x) for x in ("documents", "source_targets", "parsed"))
    mixed = mixing.mix(d, t, p)
    caps = {r.source: r.max_repeats for r in t.collect()}
    rows = mixed.collect()
    assert all(1 <= r.repeats <= caps[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    texts = {r.doc_id: r.text for r in d.collect()}
    assert len({texts[r.doc_id] for r in rows}) == len(rows)
    got = {r.source: r for r in mixing.shares(mixed, t).collect()}
    used = sum(r.target_share for r in got.values() if r.tokens)
    assert len(got) == 11 and abs(sum(r.actual_share for r in got.values()) - 1) < 1e-9
    assert all(abs(r.actual_share - r.target_share / used) < 0.002 for r in got.values() if r.tokens)


def test_cases(spark):
    d = spark.createDataFrame([(1, "one two three", "a", None, None, 1), (1, "one two three", "a", None, None, 1), (2, "one two three", "b", "en", "k", 1), (3, None, "a", "en", "k", 1), (4, " ", "a", "en", "k", 1), (5, "x", None, "en", "k", 1), (6, "four five six", "b", "hi", "k", 1), (7, "y", "unlisted", "en", "k", 1)], "doc_id long, text string, source string, lang string, doc_key string, tokens int")
    t = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 3), ("none", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    p = spark.createDataFrame([("k", "Delay in Narkera project", None)], "doc_key string, subject string, loaded_at timestamp")
    rows = {r.doc_id: r.repeats for r in mixing.mix(d, t, p).collect()}
    assert rows == {1: 3, 6: 3}
    assert mixing.mix(d.limit(0), t, p).count() == 0
    assert {r.source: r.actual_share for r in mixing.shares(mixing.mix(d, t, p), t).collect()} == {"a": 0.5, "b": 0.5, "none": 0.0}
