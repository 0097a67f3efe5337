import numpy as np
import pandas as pd

from tarkash.llm import neighbours
from tarkash.sources import read_table


def brute(ids, vectors, k, floor):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cosine = unit @ unit.T
    lists = {}
    for i, a in enumerate(ids):
        order = sorted((-cosine[i, j], b) for j, b in enumerate(ids) if j != i and cosine[i, j] >= floor)
        lists[a] = {b for _, b in order[:k]}
    return {(a, b) for a in ids for b in lists[a] if a < b and a in lists[b]}


def test_recall_on_the_table(spark):
    df = read_table(spark, "/root/testdata/sf0.01", "sub_questions")
    rows = {r.sub_question_id: r.embedding for r in df.where("embedding IS NOT NULL").collect()}
    ids = sorted(rows)
    true = brute(ids, np.array([rows[i] for i in ids]), 10, 0.9)
    got = {tuple(r) for r in neighbours.mutual(neighbours.nearest(df, "sub_question_id", "embedding", min_similarity=0.9)).collect()}
    assert got <= true and len(got & true) >= 0.98 * len(true) > 5


def test_recall_of_all_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 16))
    vectors = np.repeat(centres, 50, axis=0) + 0.5 * rng.standard_normal((3000, 16))
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vectors)], "n long, e array<double>, id string")
    got = neighbours.nearest(df, "n", "e", k=5, newest=None).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cosine = unit @ unit.T - 3 * np.eye(len(unit))
    true = {(i, int(j)) for i in range(len(unit)) for j in np.argsort(-cosine[i])[:5]}
    assert len(true & {(r.id, r.neighbour) for r in got}) >= 0.95 * len(true)


def test_recall_of_far_neighbours(spark):
    vectors = np.random.default_rng(2).standard_normal((6000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "n long, e array<float>")
    got = {(r.id, r.neighbour) for r in neighbours.nearest(df, "n", "e", k=5, newest=None).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cosine = unit @ unit.T - 3 * np.eye(len(unit), dtype=np.float32)
    true = {(i, int(j)) for i in range(len(unit)) for j in np.argsort(-cosine[i])[:5]}
    assert len(true & got) >= 0.9 * len(true) and len(got) == len(true)


def test_cases(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(f"c{i:02}", one, None, 1) for i in range(30)] + [("c00", one, None, 1), ("n", None, None, 1), ("e", [], None, 1), ("z", [0.0] * 3, None, 1), ("s", [1.0, 2.0], None, 1), ("nan", [float("nan"), 1.0, 1.0], None, 1), (None, one, None, 1), ("o", [0.0, 2.0, 0.1], None, 1)]
    df = spark.createDataFrame(rows, "k string, e array<float>, loaded_at timestamp, v int")
    got = {tuple(r) for r in neighbours.mutual(neighbours.nearest(df, "k", "e", k=2, min_similarity=0.9)).collect()}
    assert got == {("c00", "c01"), ("c00", "c02"), ("c01", "c02")}
    assert neighbours.nearest(df.limit(0), "k", "e").count() == 0


def test_copies_of_one_vector_all_have_neighbours(spark):
    rows = [(f"c{i:02}", [1.0, 0.0, 0.5]) for i in range(30)] + [("o", [0.0, 2.0, 0.1])]
    df = spark.createDataFrame(rows, "k string, e array<float>")
    for floor in (-1.0, 0.9):
        got = {(r.id, r.rank): (r.neighbour, round(r.similarity, 6)) for r in neighbours.nearest(df, "k", "e", k=2, min_similarity=floor, newest=None).collect()}
        for i in range(30):
            first = [j for j in range(3) if j != i][:2]
            assert [got[f"c{i:02}", r] for r in (1, 2)] == [(f"c{j:02}", 1.0) for j in first]


def test_each_length_is_searched(spark):
    rows = [("a", [1.0, 0.1]), ("b", [1.0, 0.2]), ("c", [1.0, 0.1, 0.2]), ("d", [1.0, 0.1, 0.3]), ("e", [2.0, 0.2, 0.7])]
    got = {(r.id, r.neighbour) for r in neighbours.nearest(spark.createDataFrame(rows, "k string, e array<float>"), "k", "e", k=1, newest=None).collect()}
    assert got == {("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "d")}


def test_trees_grow_with_the_rows():
    assert [neighbours.trees_for(n) for n in (0, 1000, 145_000, 2_000_000)] == sorted(neighbours.trees_for(n) for n in (0, 1000, 145_000, 2_000_000))
    assert neighbours.trees_for(2_000_000) >= 18


def test_rows_meet_over_the_borders_of_ranges(spark, monkeypatch):
    """One tree in many ranges finds the pairs that one range finds, apart from those further from the border than its edge."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((2000, 24))
    vectors = np.concatenate((base, base + 0.1 * rng.standard_normal(base.shape))).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "n long, v array<float>")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    one = {tuple(r) for r in neighbours._forest(rows, len(vectors), 5, 0.9, 3, 7).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    many = {tuple(r) for r in neighbours._forest(rows, len(vectors), 5, 0.9, 3, 7).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert len(many & one) >= 0.99 * len(one) > 1000


def test_dense_crowd(spark):
    """More vectors about one direction than the forest compares with each other."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    v = (centre / np.linalg.norm(centre) + rng.standard_normal((22_000, 16)) * 0.0025).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(v)), "v": list(map(np.ndarray.tolist, v))}), "id bigint, v array<float>")
    found = neighbours.nearest(df, "id", "v", min_similarity=0.9, newest=None).where("id % 200 = 0").toPandas().groupby("id")["neighbour"].agg(set)
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    hits = 0
    for i in range(0, len(v), 200):
        score = unit @ unit[i]
        score[i] = -2
        hits += len(found[i] & set(np.argpartition(-score, 10)[:10].tolist()))
    assert hits >= 0.9 * 10 * len(range(0, len(v), 200))
