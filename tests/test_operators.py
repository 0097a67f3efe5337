"""Operators on small literal tables: fusion, filters, dictionary, grids, state, nested documents."""

import json

from pyspark.sql import functions as F

from tarkash.operators import dictionary, grids, retrieval, state
from tarkash.sources import documents

HIT = "doc_key string, item string, rank int"


def test_fusion_adds_every_hit(spark):
    dense = spark.createDataFrame([("A", "q1", 1), ("B", "q1", 2), ("A", "q2", 3)], HIT)
    entity = spark.createDataFrame([("B", "q1", 1)], HIT)
    fused = {r.doc_key: r for r in retrieval.fuse({"dense": dense, "entity": entity}).collect()}
    assert abs(fused["A"].rrf_score - 0.032266) < 1e-6 and fused["A"].item == "q1" and fused["A"].agreement == 0.5
    assert abs(fused["B"].rrf_score - 0.024326) < 1e-6 and fused["B"].agreement == 1.0 and fused["B"].dense_rank == 2
    best = {r.doc_key: r.rrf_score for r in retrieval.fuse({"dense": dense, "entity": entity}, mode="best_rank").collect()}
    assert abs(best["A"] - 1 / 61) < 1e-6


def test_widen(spark):
    f = lambda *s: spark.createDataFrame([(x,) for x in s], "rrf_score double")
    stats = lambda d: retrieval.fusion_stats(d).first()
    assert stats(f()).widen and stats(f(0.0149)).widen and stats(f(0.03, 0.0286)).widen
    assert not stats(f(0.032266, 0.024326)).widen and stats(f(0.032266, 0.024326)).score_gap == 0.00794


def test_relevance_filter_keeps_what_has_no_score(spark):
    df = spark.createDataFrame([(1, None), (2, 0.0), (3, -10.0)], "k int, logit double")
    assert [(r.k, r.relevance) for r in retrieval.relevance_filter(df, "logit", 0.02, 10, "k").collect()] == [(2, 0.5), (1, None)]


def test_plateau(spark):
    df = spark.createDataFrame([("a", 0.99)] * 12 + [("b", 0.99)] * 11 + [("b", 0.95), ("c", None)], "g string, r double")
    assert {r.g: r.plateau for r in retrieval.plateau(df, ["g"], "r").collect()} == {"a": True, "b": False, "c": False}


def test_display_order(spark):
    df = spark.createDataFrame([(1, None), (2, "2024-01-01"), (3, "2025-01-01"), (4, "2025-01-01")], "rank int, d string")
    assert [r.rank for r in retrieval.display_order(df, "d", "rank").orderBy("display_rank").collect()] == [3, 4, 2, 1]


def test_topk_on_empty_and_null(spark):
    df = spark.createDataFrame([(1, None, None), (2, [0.0, 0.0], ""), (3, [1.0, 0.0], "the dam dam"), (4, [1.0, 0.0], "a dam")], "k int, v array<float>, t string")
    assert [(r.k, r["rank"]) for r in retrieval.dense_topk(df, "k", "v", [1.0, 0.0], 5).collect()] == [(3, 1), (4, 2)]
    assert [r.k for r in retrieval.lexical_topk(df, "k", "t", ["dam"], 5).collect()] == [3, 4]
    assert retrieval.lexical_topk(df, "k", "t", [], 5).count() == 0 and retrieval.dense_topk(df.limit(0), "k", "v", [1.0, 0.0], 5).count() == 0


def test_topk_plan_is_bounded(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    plan = retrieval.dense_topk(df, "k", "v", [1.0, 2.0], 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan


def test_dictionary_matches_longest_first(spark):
    names = spark.createDataFrame([("Teesta", 1), ("Teesta Lower", 2), ("Lower Dam", 3), ("TEESTA", 4), (None, 5), (" ", 6)], "name string, n int")
    d = dictionary.build(names, "name", "place", F.col("n"))
    assert {(r.entity_id, r.alias) for r in d.collect()} == {("teesta", "teesta"), ("teesta_lower", "teesta lower"), ("lower_dam", "lower dam")}
    rows = spark.createDataFrame([(1, "Work at Teesta Lower dam, and Teesta; Teesta."), (2, None), (3, ""), (4, "lower dam")], "k int, t string")
    got = {(r.k, r.entity_id, r.at) for r in dictionary.match(rows, "k", "t", d).collect()}
    assert got == {(1, "teesta_lower", 2), (1, "teesta", 6), (4, "lower_dam", 0)}
    assert dictionary.match(rows.limit(0), "k", "t", d).count() == 0
    more = dictionary.merge_dictionary(d, spark.createDataFrame([("other", "place", "teesta"), ("new", "place", "new")], d.schema))
    assert more.where("entity_id = 'other'").count() == 0 and more.where("entity_id = 'new'").count() == 1


def test_abbreviations_need_the_initials(spark):
    df = spark.createDataFrame([("The Central Water Commission (CWC) and the Power Board (XYZ).",), (None,)], "t string")
    assert [(r.abbreviation, r.full) for r in dictionary.abbreviations(df, "t").collect()] == [("CWC", "Central Water Commission")]


def _grid(spark, rows):
    return spark.createDataFrame([(rows,)], "g array<array<string>>")


def test_grids(spark):
    g = lambda rows, f: _grid(spark, rows).select(f(F.col("g")).alias("x")).first().x
    assert g([["A", "1"], ["", "2"], ["B", "3"]], grids.stitch_wrapped) == [["A", "1 2"], ["B", "3"]]
    assert g([["1", "2", "4=2+3"], ["x", "", "y"], ["5"]], grids.drop_legends) == [["x", "", "y"], ["5"]]
    assert g([["a", "", "b"], ["c", "", None], ["", "", ""]], lambda c: grids.drop_empty_columns(grids.drop_empty_rows(grids.clean_cells(c)))) == [["a", "b"], ["c", ""]]
    assert g([["k", ""], ["1", "2"]], grids.render) == ["k: 1; (col 2): 2"]
    assert g([], grids.stitch_wrapped) == [] and g([], grids.drop_empty_columns) == []


def test_merged_cells(spark):
    df = spark.createDataFrame([([(0, 1, 0, 2, "ab"), (1, 2, 1, 2, "c")],)], "c array<struct<r0:int,r1:int,c0:int,c1:int,text:string>>")
    assert df.select(grids.expand_merged(F.col("c"), F.lit(2), F.lit(2)).alias("g")).first().g == [["ab", "ab"], ["", "c"]]


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "2020-01-01", "a"), (2, None, "b")], "k int, v string, x string")
    new = spark.createDataFrame([(2, "2021-01-01", "c"), (3, None, "d")], "k int, v string, x string")
    once = state.upsert(old, new, ["k"], "v")
    assert {(r.k, r.x) for r in once.collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in state.upsert(once, new, ["k"], "v").select("k", "x").collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_snapshots(spark, tmp_path):
    s = state.Snapshots(spark, str(tmp_path))
    assert s.read() is None
    s.write(spark.range(3))
    s.write(spark.range(5))
    assert s.version() == 2 and s.read().count() == 5


def test_nested_documents(spark, tmp_path):
    doc = {"question_id": "7", "session": "2024-monsoon", "house": "lok_sabha", "subject": None, "sub_questions": [{"sub_question_id": "7_a", "part_label": "a", "answer_group_id": "g1"}, {"sub_question_id": "7_b", "part_label": "b", "answer_group_id": "gone"}], "answer_groups": [{"answer_group_id": "g1", "tables": [{"table_id": "t1", "rows": [{"row_id": "r1", "cells": {"a": "1"}}]}]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text("{broken")
    good, bad = documents.read_documents(spark, str(tmp_path / "*.json"))
    good.cache()
    flat = documents.flatten(good)
    assert [r.sub_question_id for r in flat["sub_questions"].orderBy("sub_question_id").collect()] == ["2024-monsoon/lok_sabha/7#7_a", "2024-monsoon/lok_sabha/7#7_b"]
    assert {(r.answer_group_id, r.orphan) for r in flat["answer_groups"].collect()} == {("2024-monsoon/lok_sabha/7#g1", False), ("2024-monsoon/lok_sabha/7#gone", True)}
    assert flat["answer_table_rows"].select("table_id", "row_index").collect()[0] == ("2024-monsoon/lok_sabha/7#t1", 1)
    assert flat["diary_level_tables"].count() == 0 and documents.tree(spark, str(tmp_path)).count() == 2
    documents.write_report(flat["sub_questions"], str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report/csv")).count() == 2
