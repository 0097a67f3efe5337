"""Segments of replies and choice of files on literals."""

from pyspark.sql import functions as F

from tarkash.operators import files, segments


def test_parts(spark):
    df = spark.createDataFrame([("Intro (a) first (b) (c) both",), ("no marker",), ("",), (None,)], "t string")
    got = [r.p for r in df.select(segments.with_shared(segments.parts(F.col("t"))).alias("p")).collect()]
    assert [(p.label, p.body) for p in got[0]] == [(None, "Intro"), ("a", "first"), ("b", "both"), ("c", "both")]
    assert [(p.label, p.body) for p in got[1]] == [(None, "no marker")] and got[2] == [] and got[3] is None


def test_span_errors(spark):
    df = spark.createDataFrame([("d", 1, 3, "a", 9), ("d", 3, 4, "a", 9), ("d", 8, 12, "b", 9), ("d", 7, 6, "c", 9)], "k string, first int, last int, label string, n int")
    got = {(r.first, r.label): r.errors for r in segments.verify_spans(df, "k", "n").collect()}
    assert got == {(1, "a"): [], (3, "a"): ["overlap", "label"], (8, "b"): ["range"], (7, "c"): ["reversed"]}


def test_shared_groups(spark):
    df = spark.createDataFrame([("d", "a", 3, 5, "x"), ("d", "b", 3, 5, "y"), ("d", "c", 7, 8, "x"), ("d", "d", None, None, None), ("d", "e", None, None, "")], "k string, label string, first int, last int, body string")
    got = {r.label: r.answer_group for r in segments.shared_groups(df, "k").collect()}
    assert got == {"a": 1, "b": 1, "c": 2, "d": 3, "e": 4}


def test_question_ids(spark):
    names = [("LSQ 1999, 26.02.15", "1999", "lok_sabha"), ("RSQ S 2524 19.03.15", "s-2524", "rajya_sabha"), ("AQ 125 (revised)", "125", "vidhan_sabha"), ("Annexure", "annexure", None)]
    df = spark.createDataFrame([(n[0],) for n in names], "f string")
    assert [tuple(r) for r in df.select("f", files.question_id(F.col("f")), files.house_of_folder(F.col("f"))).collect()] == names


def test_latest(spark):
    df = spark.createDataFrame([(1, "draft reply.docx", "2020-01-01"), (1, "final reply.docx", "2020-01-01"), (1, "final reply.pdf", "2020-01-01"), (1, "~$final reply.pdf", "2021-01-01"), (2, "note.docx", None)], "q int, name string, at string").withColumn("at", F.to_timestamp("at"))
    assert {(r.q, r.name, r.ties) for r in files.latest(df, ["q"], "name", "at").collect()} == {(1, "final reply.pdf", 1), (2, "note.docx", 0)}


def test_answers_of_replies(spark):
    texts = [
        ("Intro (a) when? (b) why? Comment: soon (A) near Answer - rain (c) who? Reply: all",),
        ("(c) not a start Comment: x (d) y",), ("(b) one Comment:  Reply: two (c) three",), ("no mark",), ("",), (None,),
    ]
    got = [r.a for r in spark.createDataFrame(texts, "t string").select(segments.answers_of(F.col("t")).alias("a")).collect()]
    assert got == [["soon (A) near", "rain", "all"], ["x (d) y"], ["two"], [], [], None]


def test_recovered_answers(spark):
    rows = [
        ("(a) When  will it end?", "x (a) when will\nit END? Comment: in May (b) why", "in May"), ("When?", "Where? Reply: here", None), ("When?", "when? no mark", None),
        ("", "Reply: x", None), (None, "Reply: x", None), ("When?", None, None), ("When?", "when? Reply: (b) then", "(b) then"),
    ]
    df = spark.createDataFrame(rows, "q string, s string, want string")
    assert [r.a for r in df.select(segments.recovered(F.col("q"), F.col("s")).alias("a")).collect()] == [r[2] for r in rows]
