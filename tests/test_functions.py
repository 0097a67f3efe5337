"""Literal cases of the text, date, label and path functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarkash.functions import text as T

D = dt.date
NO = lambda: F.lit(None).cast("int")
CASES = [
    (T.strip_filler, "list of all ongoing projects in J&K", "ongoing projects in J&K"), (T.strip_filler, "all", "all"), (T.strip_filler, "Please provide the details of dams", "dams"), (T.strip_filler, None, None),
    (lambda c: T.parse_date(c), "03.02.02022", D(2022, 2, 3)), (lambda c: T.parse_date(c, F.lit(2024)), "28.11.20", D(2024, 11, 28)), (lambda c: T.parse_date(c), "31.02.2024", None), (lambda c: T.parse_date(c), "5th March 2021", D(2021, 3, 5)), (lambda c: T.parse_date(c), "12/25/2020", D(2020, 12, 25)), (lambda c: T.parse_date(c), "", None),
    (lambda c: T.gate_date(T.parse_date(c), F.lit(2025)), "2019-11-08", None), (lambda c: T.anchored_date(c, NO()), "MOU of 20.07.2020; for answer on 03.02.2022", D(2022, 2, 3)), (lambda c: T.anchored_date(c, NO()), "signed on 20.07.2020", None), (lambda c: T.anchored_date(c, NO()), "x" * 100_000 + " dated 1-2-2020", D(2020, 2, 1)),
    (T.session_slug, "PARLIAMENT NOV DEC 2025", "2025-nov-dec"), (T.session_slug, "PARLIAMENT MONSOON 25", "2025-monsoon"), (T.session_slug, "PARLIAMENT NOV 23-JAN 24", "2023-nov-jan"), (T.session_slug, "PARLIAMENT DEC-JAN 1915", None), (T.session_year, "2024-monsoon", 2024), (T.session_year, "x", None),
    (T.language_tag, "abc", "en"), (T.language_tag, "नमस्ते", "hi"), (T.language_tag, "abc नमस्ते", "mixed"), (T.language_tag, "", "en"),
    (T.answer_type, "Does not pertain to this company.", "not_applicable"), (T.answer_type, "May be replied by the ministry.", "deferred_to_ministry"), (T.answer_type, "", "substantive"), (T.answer_type, "Nil.", "nil"), (T.answer_type, None, "substantive"), (T.answer_type, "May be replied by the ministry. " + "word " * 60, "substantive"),
    (T.merge_key, "Lower Subansiri Hydroelectric Project", "lower|subansiri"), (T.merge_key, "Subansiri Lower HE Poject", "lower|subansiri"), (T.merge_key, "EIA Notification 2006", "2006|eia|notification"), (T.merge_key, "Project 500 MW", ""),
    (T.slug, "Himachal Pradesh", "himachal_pradesh"), (T.slug, "Teesta-VI", "teesta_vi"), (T.slug, "...", "entity"), (T.slug, None, None),
    (T.annexure_labels, "see Annexure-I, annex 2 and ANNEXURE I", ["Annexure-I", "Annexure-2"]), (T.annexure_labels, None, []), (T.label_number, "IV", 4), (T.label_number, "b", 2), (T.label_number, "12", 12), (T.label_number, "?", None),
    (T.house_of, "Lok  Sabha", "lok_sabha"), (T.house_of, "CSR", None), (T.column_role, "S. No", "qno"), (T.column_role, "परियोजना का नाम", "project_name"), (T.column_role, "remarks", "other"),
    (T.seconds_of, "30d", 2592000), (T.seconds_of, "12h", 43200), (T.seconds_of, "90m", 5400), (T.seconds_of, "5x", None), (T.shorten, "a" * 50, "a" * 39 + "…"), (T.shorten, "abc", "abc"),
    (T.content_type, "a/b.PDF", "application/pdf"), (T.content_type, "x", "application/octet-stream"), (T.is_noise, "a/.git/b", True), (T.is_noise, "a/~$b.docx", True), (T.is_noise, "a/b.docx", False), (T.redact_dsn, "db://u:secret@h/x", "db://u:***@h/x"), (T.numbered_lines, "a\nb", "1: a\n2: b"),
]


def test_literals(spark):
    for n, (f, given, wanted) in enumerate(CASES):
        df = spark.createDataFrame([(given,)], "x string").select(f(F.col("x")).alias("y"))
        got = df.first().y
        assert got == wanted, (n, given, got, wanted)


@pytest.mark.parametrize(("x", "y"), [(0.0, 0.5), (-1000.0, 0.0), (1000.0, 1.0)])
def test_sigmoid(spark, x, y):
    assert abs(spark.range(1).select(T.sigmoid(F.lit(x)).alias("y")).first().y - y) < 1e-9


def test_cells_and_grounding(spark):
    df = spark.createDataFrame([({"b": "2", "a": "1", "c": " "}, ["x", "y"], ["x"])], "m map<string,string>, w array<string>, s array<string>")
    r = df.select(T.render_cells(F.col("m")).alias("line"), T.grounding(F.col("w"), F.col("s")).alias("g"), T.apply_synonyms(F.lit("the hydro power dam"), {"hydro": "water", "hydro power": "hydel"}).alias("s")).first()
    assert (r.line, r.g, r.s) == ("a: 1; b: 2", 0.5, "the hydel dam")
