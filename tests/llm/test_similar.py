import pytest
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from tarkash.llm import similar
from tarkash.sources import read_table

SCHEMA = "k string, q string, a string, loaded_at timestamp, class string, ids int"


def brute(rows, n=3, threshold=0.6):
    sets = {}
    for k, q, a in rows:
        w = similar.words_of(q, a)
        sets[k] = set(zip(*(w[i:] for i in range(n)), strict=False))
    out = set()
    for x, y in combinations(sorted(sets), 2):
        both = len(sets[x] | sets[y])
        if both and len(sets[x] & sets[y]) >= threshold * both - 1e-9:
            out.add((x, y))
    return out


def pairs(df, **options):
    return {tuple(r) for r in similar.similar_pairs(df, "k", ["q", "a"], sketch_bits=16, **options).collect()}


def test_equals_brute_force_on_the_table(spark):
    df = read_table(spark, "/root/testdata/sf0.01", "sub_questions").selectExpr("sub_question_id k", "question_text q", "answer_text a", "loaded_at").where("k < '2021'")
    rows = {r.k: (r.k, r.q, r.a) for r in df.collect()}
    got = pairs(df)
    assert got == brute(rows.values()) and len(got) > 5


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdef"), max_size=9), min_size=2, max_size=14), st.sampled_from([1, 3]), st.sampled_from([3, 20_000]))
def test_equals_brute_force_on_short_texts(spark, texts, n, tile):
    rows = [(f"{i:02}", " ".join(t), None) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, None, "x", 1) for r in rows], SCHEMA)
    nonempty = brute(rows, n)
    got = pairs(df, n=n, tile=tile, block_grams=20)
    short = {(x, y) for x, y in got - nonempty if rows[int(x)][1] == rows[int(y)][1]}  # copies without any n-gram
    assert got - short == nonempty


def test_cases(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    rows = [("a", text, None, None, "c", 1), ("a", text, None, None, "c", 1), ("b", text, None, None, "c", 1), ("c", text, "", None, "c", 1), ("d", text.upper() + "!", None, None, "c", 1), (None, text, None, None, "c", 1), ("e", None, None, None, None, None), ("f", "", "", None, None, None), ("g", "z " * 50_000, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert pairs(df) == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")}
    assert pairs(df, expand=1) >= {("a", "b"), ("a", "d")}
    groups = {r.id: (r["class"], r["group"], r.links) for r in similar.similar_groups(df, "k", ["q", "a"], sketch_bits=16).collect()}
    assert groups["d"][1] == "a" and groups["b"][:2] == ("a", "a") and groups["e"] == ("e", "e", 0) and len(groups) == 7
    assert pairs(df.limit(0)) == set()


def test_components(spark):
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("x", "y"), ("z", "y"), ("y", "y")]
    got = {r.node: r.group for r in similar.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert set(got) == {f"{i:03}" for i in range(41)} | {"x", "y", "z"}
    assert all(g == ("000" if n[0].isdigit() else "x") for n, g in got.items())


def test_the_sketch_grows_with_the_text(spark):
    small = spark.createDataFrame([("some words here", None)], "q string, a string")
    large = spark.createDataFrame([("word " * 100_000, "x")] * 20, "q string, a string")
    assert similar.bits_for(small, ["q", "a"]) == similar.bits_for(small.limit(0), ["q", "a"]) == similar.LEAST_BITS
    assert similar.bits_for(large, ["q", "a"]) == 21


def test_unsettled_components_are_an_error(spark):
    path = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    with pytest.raises(RuntimeError):
        similar.components(path, rounds=1)
