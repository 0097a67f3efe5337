from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tarkash.functions import replies as P
from tarkash.functions import text as T
from tarkash.operators import crawl, dictionary, grids, state


def one(spark, make, *values):
    """The results of a Column function on each value."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v")).alias("x")).collect()]


def test_signals(spark):
    assert one(spark, P.starred_of, "STARRED question", "Unstarred Question", "a reply", None) == [True, False, None, None]
    assert one(spark, P.subject_of, "Reply regarding 'Delay in project'.", "Subject: roads\nmore", "nothing", None) == ["Delay in project", "roads", None, None]
    assert one(spark, P.diary_numbers, "Dy. No. S2542 & s2544, 12", "Question No: 77", "none", None) == [["S2542", "S2544", "12"], ["77"], [], []]
    assert one(spark, P.points_to_table, "The details are given below:", "as follows, see Annexure-I", "no") == [True, False, False]
    assert one(spark, P.is_mail_wrapper, "From: a\nTo: b\nSubject: c\nFwd: x\n2 attachments", "From here to there", "From: a\nTo: b\nre: x" + " word" * 900) == [True, False, False]
    assert one(spark, lambda c: P.looks_like_place(c, ("sikkim hydro",)), "Uttar Pradesh", "2020-feb", "Reply", "Sikkim Hydro", "X") == [True, False, False, False, False]
    assert one(spark, lambda c: P.reply_format(c, F.lit(1), F.lit(0)), "Dear Sir, kindly", "text", None) == ["covering_letter", "unknown", "unknown"]
    assert one(spark, lambda c: P.reply_format(c, F.lit(3), F.length(c) - 4), "sixsix", "five5") == ["interleaved", "questions_then_answers"]


def test_numbers_and_times(spark):
    assert [(r.number, r.label) for r in one(spark, lambda c: P.question_number(c, F.lit("77")), "S-123", "(a)", "what is it", None)] == [("S-123", None), ("77", "(a)"), ("77", None), ("77", None)]
    assert one(spark, P.annexure_numbers, "Annexure-II.pdf", "annex 3 and annexure-iv.pdf", "Annexure.pdf", "reply.pdf") == [[2], [3, 4], [0], []]
    assert [x and x.isoformat() for x in one(spark, lambda c: P.iso_time(c).cast("timestamp_ntz"), "2020-01-02T03:04:05Z", "2020-01-02", "soon", None)] == ["2020-01-02T03:04:05", "2020-01-02T00:00:00", None, None]
    assert one(spark, P.before_mark, "What? Reply: this", "nothing", None) == ["What?", "", None] and one(spark, P.after_mark, "What? Reply: this. Reply: x", "all of it") == ["this. Reply: x", "all of it"]


@pytest.mark.parametrize("whole", ['{"k": [1, {"a": "x, y"}], "z": 5}', '{"k": "a \\" { b", "z": 5}'])
def test_json_cut_anywhere_is_closed(spark, whole):
    rows = one(spark, lambda c: F.from_json(P.closed_json(c), "k string, z int").isNotNull(), *[whole[:n] for n in range(1, len(whole) + 1) if whole[n - 1] not in '\\:' and not whole[:n].endswith(('"k', '"z', '"a', ', "'))])
    assert all(rows)
    assert one(spark, lambda c: F.from_json(P.closed_json(c), "z int")["z"], f"```json\n{whole}\n```", f"Here: {whole}", "no json") == [5, 5, None]


def test_model_output(spark):
    raw = '```json\n[{"id": "1", "verdict": "Similar", "reason": "r"}, {"id": "x", "verdict": "similar"}, {"id": 2, "verdict": "maybe"}, {"verdict": "similar"}, {"id": 3, "verdict": "not_similar"}]\n```'
    assert [(v.id, v.verdict, v.reason) for v in one(spark, P.verdicts, raw)[0]] == [(1, "similar", "r"), (3, "not_similar", "")]
    assert one(spark, P.verdicts, "no list", None) == [None, None]
    assert [(e.name, e.kind) for e in one(spark, P.model_entities, '[{"name": "Narkera", "type": "Project"}, {"name": "Abc", "type": "state"}, {"name": "power station", "type": "project"}, {"name": "River", "type": "river"}]')[0]] == [("Narkera", "project")]
    assert one(spark, P.pair_errors, '{"pairs": [{"question_number": "1", "question_text": "q", "answer_text": "a"}, {"answer_is_table": true, "confidence": "none"}]}', "x") == [["1:question_number", "1:confidence"], ["pairs"]]


def test_synonyms_are_literal_and_spare_names(spark):
    assert one(spark, lambda c: T.apply_synonyms(c, {"u.t": "union $1 territory", "power": "energy"}), "the u.t of uat", "Power (power)") == ["the union $1 territory of uat", "energy (energy)"]
    assert one(spark, lambda c: T.apply_synonyms(c, {"power": "energy", "": "x"}, ("hydro power", "power")), "hydro power and power", "powerful") == ["hydro power and power", "powerful"]
    assert one(spark, lambda c: T.apply_synonyms(c, {"power": "energy"}, ("hydro power",)), "hydro power and power, Hydro Power", None) == ["hydro power and energy, Hydro Power", None]


def greedy(words, aliases):
    spans = sorted(((-len(" ".join(words[i : i + n])), i, n) for n in range(1, 5) for i in range(len(words) - n + 1) if " ".join(words[i : i + n]) in aliases))
    kept = []
    for _, i, n in spans:
        if all(i + n <= j or j + m <= i for j, m in kept):
            kept.append((i, n))
    return {" ".join(words[i : i + n]) for i, n in kept}


def test_match_equals_greedy_choice(spark):
    aliases = ["a", "a b", "b c", "c d a", "d"]
    texts = [" ".join(p) for p in permutations("abcda", 5)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    names = spark.createDataFrame([(x.replace(" ", "_"), x) for x in aliases], "entity_id string, alias string")
    got = {}
    for r in dictionary.match(rows, "k", "t", names).collect():
        got.setdefault(r.k, set()).add(r.alias)
    assert all(got.get(i, set()) == greedy(t.split(), set(aliases)) for i, t in enumerate(texts))
    assert {r.k: r.text for r in dictionary.canonical(rows.limit(1), "k", "t", names).collect()}[0] == "a_b c_d_a"


def test_grids(spark):
    def run(make, grid):
        return spark.createDataFrame([(grid,)], "g array<array<string>>").select(make(F.col("g"))).first()[0]

    assert run(grids.merge_header, [["no", "cost"], ["", "in crore"], ["1", "5"]]) == [["no", "cost in crore"], ["1", "5"]]
    assert run(grids.merge_header, [["no", "cost"], ["1", "5"], ["2", "6"]]) == [["no", "cost"], ["1", "5"], ["2", "6"]]
    assert run(grids.merge_split_columns, [["no", "", "x"], ["1", "", "a"], ["", "2", "b"]]) == [["no", "x"], ["1", "a"], ["2", "b"]]
    assert run(grids.merge_split_columns, [["no", "", "x"], ["1", "7", "a"]]) == [["no", "", "x"], ["1", "7", "a"]]
    assert run(grids.orientation, [["a", "b"], ["1", "2"]]) == "rows" and run(grids.orientation, [["a", "b", "c"]] + [[f"{i} Energy", "1", "2"] for i in range(3)]) == "transposed"


def test_annexures_and_spans(spark):
    refs = spark.createDataFrame([("d", "Annexure-I"), ("d", "Annexure-II"), ("d", "Annexure-III"), ("e", "Annexure-I"), ("f", "Annexure-I")], "k string, label string")
    files = spark.createDataFrame([("d", "annexure-1.docx"), ("d", "annexure-i.pdf"), ("d", "Annex II.doc"), ("e", "annexure.pdf"), ("f", "note.pdf")], "k string, f string")
    assert {(r.k, r.label, r.f, r.confidence) for r in crawl.resolve_annexures(refs, files, "k", "label", "f").collect()} == {("d", "Annexure-I", "annexure-i.pdf", "low"), ("d", "Annexure-II", "Annex II.doc", "high"), ("d", "Annexure-III", None, "none"), ("e", "Annexure-I", "annexure.pdf", "low"), ("f", "Annexure-I", None, "none")}
    spans = spark.createDataFrame([("d", 0, 3, 1, 9, 1), ("d", 5, 4, 1, 9, 2), ("d", 3, 20, 1, 9, 3)], "k string, first int, last int, least int, most int, id int")
    assert sorted((r.first, r["last"]) for r in crawl.repair_spans(spans, ["k"], "least", "most", "id").select("first", "last").collect()) == [(1, 2), (3, 3), (4, 5)]


def test_state(spark, tmp_path):
    table = state.Snapshots(spark, f"file://{tmp_path}/t")
    assert table.read() is None
    for n in (3, 5):
        table.write(spark.range(n))
    assert table.version() == 2 and table.read().count() == 5
    assert state.append_log(spark.range(2), f"file://{tmp_path}/log") and state.append_log(spark.range(2), f"file://{tmp_path}/log") and spark.read.json(f"file://{tmp_path}/log").count() == 4
    assert not state.append_log(spark.range(2), "nosuch://x/log")
    rows = dictionary.settle(spark.createDataFrame([("e", "b", "low", True), ("e", "a", "high", False), ("f", "c", None, True)], "e string, n string, c string, r boolean"), "e", "n", "c", "r")
    assert sorted(map(tuple, rows.collect())) == [("e", "a", "high", False), ("f", "c", None, True)]
