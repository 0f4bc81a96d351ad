"""Rewritten joins and windows against their definitions, with nulls, ties and repeats."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.vector import cosine, dot
from millrace.operators import joins, windows
from millrace.operators.patterns import match_rows

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
KEY, TIME = st.one_of(st.none(), st.integers(0, 2)), st.one_of(st.none(), st.integers(0, 12))


@FEW
@given(left=st.lists(st.tuples(KEY, TIME), max_size=12), right=st.lists(st.tuples(KEY, st.integers(0, 12)), max_size=8, unique=True), equal=st.booleans(), width=st.sampled_from([None, 1.0, 4.0, 100.0]))
def test_asof(spark, left, right, equal, width):
    a = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(left)], "id int, k int, t int")
    b = spark.createDataFrame([(k, t, 100 * (k or 0) + t) for k, t in right], "k int, t int, v int")
    got = {r.id: r.v_right for r in joins.asof_join(a, b, "t", ["k"], allow_equal=equal, width=width).collect()}
    for i, (k, t) in enumerate(left):
        ok = [s for j, s in right if k is not None and t is not None and j == k and (s <= t if equal else s < t)]
        assert got[i] == (100 * k + max(ok) if ok else None)
    assert len(got) == len(left)


@FEW
@given(points=st.lists(st.integers(-20, 20), max_size=15), spans=st.lists(st.tuples(st.integers(-20, 20), st.integers(0, 15)), max_size=10), width=st.sampled_from([1.0, 4.0, 50.0]))
def test_range_and_overlap(spark, points, spans, width):
    p = spark.createDataFrame([(i, x) for i, x in enumerate(points)], "i int, x int")
    s = spark.createDataFrame([(j, a, a + n) for j, (a, n) in enumerate(spans)], "j int, low int, high int")
    got = sorted((r.i, r.j) for r in joins.range_join(p, s, F.col("x"), F.col("low"), F.col("high"), width).collect())
    assert got == sorted((i, j) for i, x in enumerate(points) for j, (a, n) in enumerate(spans) if a <= x < a + n)
    t = s.select(F.col("j").alias("k"), F.col("low").alias("lo"), F.col("high").alias("hi"))
    got = sorted((r.j, r.k) for r in joins.overlap_join(s, t, F.col("low"), F.col("high"), F.col("lo"), F.col("hi"), width).collect())
    assert got == sorted((j, k) for j, (a, n) in enumerate(spans) for k, (b, m) in enumerate(spans) if a < b + m and b < a + n)


def test_large_keys_go_in_parts_that_all_meet(spark, monkeypatch):
    """Repeats, nulls, equal times, further keys, columns of one name on both sides: each pair once."""
    for name, n in (("BLOCKS", (2, 2)), ("LEFT", 3), ("RIGHT", 2), ("TASKS", 5)):
        monkeypatch.setattr(joins, name, n)
    points = [(i, i * i % 23 if i % 7 else None, i % 2 if i % 5 else None) for i in range(60)] + [(99, 4, 0)] * 9
    spans = [(j, j * 5 % 19, j % 6, j % 2) for j in range(25)] + [(77, 3, 4, 0)] * 7
    p = spark.createDataFrame(points, "id int, x int, k int")
    s = spark.createDataFrame([(j, a, a + n, k) for j, a, n, k in spans], "id int, low int, high int, g int")
    for on in ((), ((F.col("k"), F.col("g")),)):
        got = joins.range_join(p, s, F.col("x"), F.col("low"), F.col("high"), 4.0, on)
        assert got.columns == ["id", "x", "k", "id", "low", "high", "g"]
        want = [(i, x, k, j, a, a + n, g) for i, x, k in points for j, a, n, g in spans if x is not None and a <= x < a + n and (not on or k == g)]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    t = s.select(F.col("id").alias("k"), F.col("low").alias("lo"), F.col("high").alias("hi"))
    got = sorted((r.id, r.k) for r in joins.overlap_join(s, t, F.col("low"), F.col("high"), F.col("lo"), F.col("hi"), 4.0).collect())
    assert got == sorted((j, k) for j, a, n, _ in spans for k, b, m, _ in spans if a < b + m and b < a + n)


def test_pairs_come_in_an_order_that_files_keep_small(spark, tmp_path):
    """Pairs are many times the rows; in the order of a row by row join these take 1.3 bytes each, in blocks 0.2."""
    p = spark.range(20_000).select("id", (F.col("id") * 7919 % 20_000).alias("x"))
    s = spark.range(4_000).select(F.col("id").alias("j"), (F.col("id") * 5).alias("low"), (F.col("id") * 5 + 2_500).alias("high"))
    joins.range_join(p, s, F.col("x"), F.col("low"), F.col("high"), 1_666.0).select("id", "j").write.parquet(str(tmp_path / "out"))
    found = spark.read.parquet(str(tmp_path / "out"))
    want = sum(min(20_000, 5 * j + 2_500) - 5 * j for j in range(4_000))
    assert (found.count(), found.distinct().count()) == (want, want)
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.4 * want


@FEW
@given(left=st.lists(KEY, max_size=6), right=st.lists(KEY, max_size=4))
def test_not_in_join_equals_not_in(spark, left, right):
    a, b = spark.createDataFrame([(x,) for x in left], "k int"), spark.createDataFrame([(x,) for x in right], "k int")
    got = [r.k for r in joins.not_in_join(a, b, "k", "k").collect()]
    want = [x for x in left if not right or x is not None and None not in right and x not in right]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_salted_join_equals_join(spark):
    big = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(200)] + [(None, 1)], "k int, v int")
    small = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (None, "d")], "k int, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want, got = big.join(small, "k", how), joins.salted_join(big, small, ["k"], 4, how)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError):
        joins.salted_join(big, small, ["k"], how="full")


def test_sized_join_broadcasts_within_its_limit_only(spark):
    a, b = spark.range(1000), spark.range(10)
    assert "BroadcastHash" in joins.sized_join(a, b, ["id"])._jdf.queryExecution().optimizedPlan().toString() or "strategy=broadcast" in joins.sized_join(a, b, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in joins.sized_join(a, b, ["id"], limit=1)._jdf.queryExecution().optimizedPlan().toString()


def test_windows(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 1, 20), ("a", 2, 5), ("a", 4, 1), ("b", None, 7)], "g string, o int, v int")
    got = {(r.g, r.o, r.v): r.s for r in windows.groups_frame(df, ["g"], ["o"], -1, 0, s=F.sum("v")).collect()}
    assert got == {("a", 1, 10): 30, ("a", 1, 20): 30, ("a", 2, 5): 35, ("a", 4, 1): 6, ("b", None, 7): 7}
    assert windows.distinct_on(df, ["g"], [F.desc("v")]).count() == 2
    assert windows.groups_frame(df.limit(0), ["g"], ["o"], -1, 0, s=F.sum("v")).count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    rows = df.select(dot("a", "b").alias("d"), cosine("a", "b").alias("c")).collect()
    assert (rows[0].d, round(rows[0].c, 9), rows[1].c) == (10.0, 1.0, None)


@FEW
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 2)), st.integers(0, 3)), max_size=30), pattern=st.sampled_from(["ab+", "a(b|c)*", "[ab]c", "b*", "x"]))
def test_row_patterns(spark, rows, pattern):
    import re

    df = spark.createDataFrame([(k, t, v) for t, (k, v) in enumerate(rows)], "k int, t int, v int").repartition(3)
    define = {"a": F.col("v") == 0, "b": F.col("v") <= 1, "c": F.col("v") == 2}
    got = sorted(((r.k, r.match, r.n, r.t_first, r.t_last, r.v_first, r.v_last) for r in match_rows(df, ["k"], ["t"], define, pattern, ["v"]).collect()), key=str)
    want = []
    for key in {k for k, _ in rows}:
        mine = [(t, v) for t, (k, v) in enumerate(rows) if k == key]
        found = [m for m in re.finditer(pattern, "".join("abc-"[v] for _, v in mine)) if m[0]]
        want += [(key, i, len(m[0]), mine[m.start()][0], mine[m.end() - 1][0], mine[m.start()][1], mine[m.end() - 1][1]) for i, m in enumerate(found, 1)]
    assert got == sorted(want, key=str)


def test_row_patterns_with_windows_and_bad_names(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame([(t, v) for t, v in enumerate([5, 4, 3, 4, 6, 2, 1, 9])], "t int, v int").withColumn("g", F.lit(1))
    before = F.lag("v").over(Window.partitionBy("g").orderBy("t"))
    found = match_rows(df, ["g"], ["t"], {"d": F.col("v") < before, "u": F.col("v") > before}, "d+u+").collect()
    assert [(r.t_first, r.t_last) for r in sorted(found)] == [(1, 4), (5, 7)]
    with pytest.raises(ValueError):
        match_rows(df, ["g"], ["t"], {"down": F.lit(True)}, "d")


ROWS = st.lists(st.tuples(KEY, st.one_of(st.none(), st.sampled_from([-3.5, 0.0, 1.25, 7.0, 7.5, 1e6, float("inf"), float("nan")]))), min_size=1, max_size=25)


@FEW
@given(rows=ROWS, size=st.sampled_from([1, 3, 100]))
def test_running_sums_and_percentiles_in_stretches(spark, rows, size):
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], "i int, k int, v double")
    w = Window.partitionBy("k").orderBy("v", "i")
    want = df.select("i", F.row_number().over(w).alias("n"), F.sum("i").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.count("*").over(Window.partitionBy("k")).alias("n_total"))
    got = windows.running(df, ["k"], ["v", "i"], size, n=F.lit(1), s=F.col("i")).select("i", "n", "s", "n_total")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    some = df.where("v IS NULL OR abs(v) < 1e300")
    want = some.groupBy("k").agg(F.percentile("v", 0.5), F.percentile("v", 0.9)).collect()
    got = windows.percentiles(some, ["k"], "v", {"a": 0.5, "b": 0.9}, size).collect()
    plain = lambda rs: sorted((tuple(None if x is None else round(x, 6) for x in r) for r in rs), key=str)
    assert plain(got) == plain(want)


def test_stretches_share_out_a_large_partition(spark):
    """In even bins of numbers, and between bounds where most rows share a few numbers."""
    for value in (F.col("id") * 0.5, F.pmod(F.xxhash64("id"), F.lit(3)) + F.when(F.col("id") == 0, 1e12).otherwise(0)):
        df = spark.range(20_000).select("id", value.alias("v"))
        sizes = [r["count"] for r in df.withColumn("c", windows.chunk_of(df, ["v", "id"], 1_000)).groupBy("c").count().collect()]
        assert sum(sizes) == 20_000 and len(sizes) > 10 and max(sizes) < 4_000


@FEW
@given(rows=st.lists(st.tuples(KEY, TIME, st.one_of(st.none(), st.integers(-5, 5))), max_size=20), start=st.integers(-2, 0), end=st.integers(0, 1))
def test_sums_over_groups_of_peers(spark, rows, start, end):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k int, t int, v int")
    want = windows.groups_frame(df, ["k"], ["t"], start, end, s=F.sum("v")).select("i", "s").collect()
    assert sorted(windows.groups_sums(df, ["k"], ["t"], start, end, s=F.col("v")).select("i", "s").collect(), key=str) == sorted(want, key=str)
