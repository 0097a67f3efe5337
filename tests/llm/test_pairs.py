import pytest

from tarkash.llm import pairs

Q = "whether the bridge at Narkera was repaired in 2019; and the steps taken by Government to repair the approach road?"
A = "The bridge at Narkera was repaired in March 2019. The approach road is being widened by the state agency."


@pytest.mark.parametrize(
    ("answer", "defect"),
    [
        (None, "empty"), ("", "empty"), (" \n", "empty"), ("​", "empty"), ("____", "empty"), ("(a) to (c):", "empty"), ("उत्तर:", "empty"), ("Reply:", "empty"),
        ("Nil.", None), ("No, Sir.", None), ("Does not arise.", None), (A, None), (Q, "copied"), ("Reply: " + Q.upper(), "copied"), (Q + " " + A, None),
        ("We regret that the information sought cannot be furnished.", "refusal"), ("(a) & (b): With regret, no reply can be offered on this point as the contract forbids it", "refusal"), ("Reply to this part may be given by the power department.", None),
        ("The vendor declined to furnish a bank guarantee. " + A, None), ("यह सूचना गोपनीय है, अतः उत्तर देने में असमर्थ हैं।", "refusal"),
        ("पुल की मरम्मत मार्च 2019 में की गई है।", "other_language"), ("Pul ki marammat March 2019 mein poori ki gayi hai.", "other_language"), ("The bridge was repaired. पुल की मरम्मत मार्च 2019 में की गई है।", None),
    ],
)
def test_rules(answer, defect):
    assert pairs.rule_defect(Q, answer) == defect


def test_marathi_and_nepali():
    assert pairs.languages_of("पुलाची दुरुस्ती मार्च 2019 मध्ये पूर्ण झाली आहे.") == {"mr"}
    assert pairs.languages_of("पुलको मर्मत सम्पन्न भएको छ।") == {"ne"}


def test_truncated_and_cases(spark):
    said = ["The road was repaired by the state agency.", "The dam was inspected by the state agency in May.", "Funds were released by the state agency.", "The canal was cleaned by the agency.", "The gate was painted by the agency."] * 3
    rows = [(f"w{i:02}", Q, t, None, "x") for i, t in enumerate(said)]
    rows += [("t1", Q, "The bridge at Narkera was repaired by the", None, "x"), ("t2", Q, "The road was repaired by the state (contd", None, "x"), ("ok", Q, "The bridge at Narkera was repaired by the agency", None, "x")]
    rows += [(None, Q, "", None, None), ("n", None, None, None, None), ("long", Q, "The dam was inspected by the state agency in May. " * 5000, None, None)]
    rows += [("re", Q, "", "2020-01-01", None), ("re", Q, A, "2020-02-01", None), ("re", Q, A, "2020-02-01", None)]
    df = spark.createDataFrame(rows, "k string, q string, a string, loaded_at string, defect string")
    got = {r.k: r.defect for r in pairs.defective_pairs(df, "k", "q", "a").collect()}
    assert got == {"t1": "truncated", "t2": "truncated", "n": "empty"}
    assert pairs.defective_pairs(df.limit(0), "k", "q", "a").count() == 0


def test_limit(spark):
    rows = spark.createDataFrame([(100, True)] * 20 + [(n, True) for n in range(90, 110)] + [(100, False)], "length long, open boolean")
    assert [r.length for r in pairs.limit_lengths(rows).collect()] == [100]


@pytest.mark.parametrize("parts", [1, 3, 30])
def test_continued(spark, parts):
    texts = [f"{a}{b}" for a in ("one", "two", "three") for b in ("", " more", " more words", ".")] + ["alone", "", "alone", "the dam was rep", "the dam was rep.", "the dam was rep. Then", "the dam was rep. Then more.", "the dam was repaired in May", "shut", "shut.", "shut. And more"]
    bare = {t.rstrip(".") for t in texts if t}
    true = sorted(t for t in bare if any(x.startswith(t) and x[len(t) : len(t) + 1] not in ("", ".") for x in bare))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = sorted(r.text for r in pairs.continued_texts(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect())
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert got == true and "the dam was rep" in got and "shut" not in got


def test_dots_cut_off(spark):
    rows = [("a", Q, "The road was repaired by the ..."), ("b", Q, "The road was repaired by the agency…"), ("c", Q, "...")]
    assert {r.k: r.defect for r in pairs.defective_pairs(spark.createDataFrame(rows, "k string, q string, a string"), "k", "q", "a", newest=None).collect()} == {"a": "truncated", "b": "truncated", "c": "empty"}


def test_a_long_refusal_is_a_refusal():
    parts = " ".join(f"The information sought in part {i} of the question cannot be furnished." for i in range(1, 9))
    assert len(parts) > 400 and pairs.rule_defect("Which canals were lined in the year?", parts) == "refusal"
    assert pairs.rule_defect("Which canals were lined in the year?", parts + " The canal of Kalkepal was lined in March.") is None
