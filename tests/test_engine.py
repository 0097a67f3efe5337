"""The engine from end to end: wrappers change nothing, blank questions answer nothing, filters hold."""

from dataclasses import replace

from tarkash.functions import models
from tarkash.plans import engine

SF = "/root/testdata/sf0.001"


def _keys(df):
    return [r.doc_key for r in df.orderBy("display_rank").collect()]


def test_paraphrases_give_the_same_list(spark):
    bare = "villages affected by the tunnel project"
    wrapped = ["list of all villages affected by the tunnel project", "Kindly provide the details of the villages affected by the tunnel project"]
    first = _keys(engine.answer(spark, SF, bare))
    assert first and all(_keys(engine.answer(spark, SF, w)) == first for w in wrapped)


def test_questions_without_words_have_no_answers(spark):
    assert _keys(engine.answer(spark, SF, "?!")) == []


def test_filters_hold_unless_widened(spark):
    o = replace(engine.Options(), house="lok_sabha", widen=1)
    rows = engine.answer(spark, SF, "tunnel villages compensation", o).collect()
    assert len(rows) <= o.most and [r.display_rank for r in sorted(rows, key=lambda r: r.display_rank)] == list(range(1, len(rows) + 1))


def test_embedder(spark):
    assert models.embed_text("a b") == models.embed_text("A  b") and models.embed_text("") is None and models.embed_text(None) is None
    df = spark.createDataFrame([(1, "a b"), (2, None)], "k int, t string")
    assert [r.vector is None for r in models.embed(df, "k", "t").orderBy("k").collect()] == [False, True]
