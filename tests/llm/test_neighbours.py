import numpy as np
import pytest

from millrace.llm import neighbours
from millrace.llm.common import table
from millrace.llm.queries import op9_neighbours


def exact(ids, x, every, k):
    x = np.asarray(x, dtype=float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = u @ u[i]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_scores(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = table(spark, d, "embeddings").toPandas()
    want = exact(rows.vec_id.values, np.stack(rows.embedding.values), 50, 5)
    got = {}
    for r in op9_neighbours(spark, d).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hit = 0
    x = dict(zip(rows.vec_id, rows.embedding))
    for q, found in got.items():
        assert [r for r, *_ in found] == [1, 2, 3, 4, 5]
        hit += len({v for _, v, _ in found} & {v for v, _ in want[q]})
        for _, v, s in found:
            a, b = (np.asarray(x[i], dtype=float) for i in (q, v))
            assert s == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)
        assert [s for *_, s in found] == sorted((s for *_, s in found), reverse=True)
    assert hit / (5 * len(want)) >= 0.9


def test_many_cells_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "AIM", 30)
    monkeypatch.setattr(neighbours, "CHUNK", 7)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8)) * 3
    x = centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact(np.arange(900), x, 20, 5)
    assert set(got) == set(want)
    assert sum(len(got[q] & {v for v, _ in w}) for q, w in want.items()) / (5 * len(want)) >= 0.9


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(0)
    for k, m in ((1, 1), (4, 6), (9, 9)):
        index = neighbours.Index(np.zeros((k, 2)), np.zeros((m, 2)), np.ones(k * m, dtype=np.int64))
        a, b = rng.random(k), rng.random(m)
        got = list(index.walk(a, b))
        assert sorted(got) == list(range(k * m))
        sums = [a[c // m] + b[c % m] for c in got]
        assert sums == sorted(sums)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(0, 200)]  # one vector that most rows share
    rows += [(200, [0.0, 1.0, 0.0]), (300, [1.0, 1.0, 0.0]), (301, [2.0, 2.0, 0.0]), (301, [2.0, 2.0, 0.0])]
    rows += [(400, None), (401, []), (450, [0.0, 0.0, 0.0]), (451, [nan, 1.0, 1.0]), (452, [inf, 1.0, 1.0]), (453, [None, 1.0, 1.0]), (None, [1.0, 0.0, 0.0]), (500, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS v", "2 AS cell", "3 AS score")
    got = {}
    for r in neighbours.search(df, 50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4], 150: [0, 1, 2, 3, 4], 200: [300, 301, 0, 1, 2], 300: [301, 0, 1, 2, 3]}
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in neighbours.search(few, 50).collect()] == [(0, 1, 1)]
    assert neighbours.search(few.limit(0), 50).count() == 0
    assert neighbours.search(few.where("vec_id = 0"), 50).count() == 0


def test_ties_of_different_vectors_go_to_the_smaller_ids(spark):
    ids = np.random.default_rng(2).permutation(60)
    rows = [(int(i), [2.0**k, 2.0**k, 0.0]) for k, i in enumerate(ids)]  # all alike but no two equal
    df = spark.createDataFrame(rows + [(100 + i, [float(i), 0.0, 1.0]) for i in range(20)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(0, 60, 10):
        assert got[q] == [i for i in range(6) if i != q][:5]
