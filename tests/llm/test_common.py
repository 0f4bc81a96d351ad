import numpy as np
import pytest

from millrace.llm.common import Shared, hashed_sample, mix, steps, unused


def test_hashed_sample_is_bounded_and_the_same_in_any_order(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS g")
    a = sorted(r.id for r in hashed_sample(df, "id", 100).collect())
    assert len(a) == 100 and a == sorted(r.id for r in hashed_sample(df.repartition(9), "id", 100).collect())
    assert hashed_sample(df.limit(0), "id", 100).count() == 0
    assert hashed_sample(df.limit(30), "id", 100).count() == 30
    assert hashed_sample(df.selectExpr("cast(null AS long) AS id"), "id", 10).count() <= 10


def test_steps_cover_all_rows():
    texts = [b"x" * n for n in (5, 0, 40, 3, 3, 3, 100, 0, 1)]
    found = list(steps(texts, 10))
    assert [i for a, z in found for i in range(a, z)] == list(range(len(texts)))
    assert all(z - a == 1 or sum(map(len, texts[a:z])) <= 10 for a, z in found)
    assert list(steps([])) == []


def test_shared_files(tmp_path):
    s = Shared(f"file://{tmp_path}/x")
    assert s.write("a/b", [b"12345678", memoryview(b"9")]) == 9
    assert s.read("a/b") == b"123456789" and s.exists("a/b") and not s.exists("a/c")
    assert bytes(s.map("a/b")) == b"123456789"
    s.write("a/b", [b""])
    assert len(s.map("a/b")) == 0 and s.names("a") == ["b"] and s.names("none") == []
    s.remove("a")
    assert not s.exists("a/b")


def test_a_temporary_folder_is_for_one_process_alone():
    class Conf:
        get = staticmethod(lambda *a: None)

    class Cluster:
        conf = Conf
        sparkContext = type("C", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: Conf)})

    with pytest.raises(ValueError):
        Shared.create(Cluster, "x")


def test_names_that_are_free():
    assert unused(["a", "B", "b_"], "a", "b", "c", "C") == ["a_", "b__", "c", "C_"]


def test_mix_spreads():
    x = mix(np.arange(1 << 16, dtype=np.uint64), 3)
    assert len(np.unique(x)) == 1 << 16
    assert abs(int(np.bitwise_count(x).sum()) / (1 << 16) - 32) < 0.1
    with pytest.raises(TypeError):
        mix(np.array(["a"]), 1)
