import collections
import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import mixing
from millrace.llm.common import Shared, table
from millrace.llm.queries import op5_mixing


def plain_targets(sizes):
    """sizes: {source: words}; by the rule's own words: share, stop at twice, reshare, until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full = {}, {s for s in order if not sizes[s]}
    target.update(dict.fromkeys(full, 0.0))
    while len(full) < len(order):
        left = 1.5 * sum(sizes.values()) - sum(target[s] for s in full)
        total = sum(weight[s] for s in order if s not in full)
        share = {s: left * weight[s] / total for s in order if s not in full}
        above = [s for s, x in share.items() if x > 2 * sizes[s]]
        if not above:
            target.update(share)
            break
        for s in above:
            target[s] = 2.0 * sizes[s]
            full.add(s)
    return target


def check(rows, docs):
    """docs: [(doc_id, text, source)]"""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for _, t, s in docs:
        sizes[s] += words(t)
    want = plain_targets(sizes)
    assert sorted(((r.doc_id, r.size) for r in rows), key=str) == sorted(((i, words(t)) for i, t, _ in docs), key=str)
    taken, largest = collections.Counter(), collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
        assert r.taken == r.copies * r.size and r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 * want[s]


def test_query_meets_the_targets(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text, r.source) for r in table(spark, sf, "documents").collect()]
    check(mixing.plan(table(spark, sf, "documents")).collect(), docs)
    again = [sorted(map(tuple, op5_mixing(spark, sf).collect())) for _ in range(2)]
    assert again[0] == again[1]
    shuffled = table(spark, sf, "documents").repartition(7, F.rand(1))
    assert sorted(map(tuple, mixing.plan(shuffled).select("doc_id", "size", "source_size", "target", "taken").collect())) == again[0]


def test_no_python_in_the_plan(spark, sf):
    plan = op5_mixing(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 1000, "b": 1, "c": 1}, {"a": 0, "b": 5}, {None: 7, "z": 9, "a": 100, "b": 3, "c": 40}, {"a": 0}, {"é": 5, "z": 5, "Z": 5, "𝒵": 5, "￿": 5}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_rounding_is_fair(spark):
    """Over many seeds a document is taken as often as it should be, and words are conserved in each."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "a" if i % 4 else "b") for i in range(40)], "doc_id long, text string, source string")
    total, runs = collections.Counter(), 12
    for seed in range(runs):
        for r in mixing.plan(docs, seed=seed).collect():
            total[r.source] += r.copies / (runs * (30 if r.source == "a" else 10))
            assert r.copies in (0, 1, 2)
    want = plain_targets({"a": sum(1 + i % 5 for i in range(40) if i % 4), "b": sum(1 + i % 5 for i in range(40) if not i % 4)})
    for s in "ab":
        n = [1 + i % 5 for i in range(40) if bool(i % 4) == (s == "a")]
        assert total[s] == pytest.approx(want[s] / sum(n), abs=0.12)


def test_odd_rows(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (3, "", None), (None, "x y", None), (None, "x y", None), (None, "z", "t"), (4, "w " * 30_000, "t"), (5, " \n", "empty")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, m int").withColumn("copies", F.lit("clash"))
    check(mixing.plan(docs).collect(), rows)
    planned = mixing.plan(docs).agg(F.sum("copies")).first()[0]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == planned
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(None, "a b c d", "s")] * 900, "doc_id long, text string, source string")
    check(mixing.plan(same).collect(), [(None, "a b c d", "s")] * 900)


def test_blocks_hold_few_documents(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 9 AS int)) AS text", "if(id % 3 = 0, 'hot', concat('s', id % 50)) AS source")
    shared = Shared.create(spark, "mix-test")
    mixing.copies(docs, shared).count()
    most = spark.read.parquet(shared.uri("level-0")).agg(F.max(F.size("x.done"))).first()[0]
    assert most < 4 * mixing.FAN
    assert np.isfinite(most)


def test_columns_of_any_name_and_type(spark):
    rows = [(1, "a b c", "s", i % 3) for i in range(60)] + [(i, "a b", "s", 0) for i in range(2, 9)] + [(20, "x " * 40, "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").selectExpr("*", "map('k', n) AS key", "1 AS Turn", "array(n) AS taken_key", "2 AS m", "3 AS `a.b`")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = collections.Counter((r.doc_id, r.n, str(r.key)) for r in mixed.collect())
    planned = collections.Counter()
    for r in mixing.plan(docs).collect():
        planned[r.doc_id] += r.copies
    assert collections.Counter({i: sum(n for (j, *_), n in got.items() if j == i) for i in planned}) == planned
    ones = [sum(n for (j, k, _), n in got.items() if j == 1 and k == v) for v in range(3)]
    assert all(0 <= n <= 40 for n in ones) and sum(ones) == planned[1]
    assert sorted(map(str, mixing.mix(docs.repartition(5, F.rand(2))).collect())) == sorted(map(str, mixed.collect()))


def test_many_repeats_come_out_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEAT", 50)
    rows = [(1, "a b", "s")] * 700 + [(2, "c d e", "s"), (3, "f", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(mixing.plan(docs).collect(), rows)
    planned = mixing.plan(docs).agg(F.sum("copies")).first()[0]
    assert mixing.mix(docs).count() == planned


def spark_hash(*values, seed=42):
    """Spark's xxhash64 of integers: every one is hashed with the last hash as its seed."""
    for v, size in values:
        seed = xxhash.xxh64_intdigest(int(v).to_bytes(size, "little", signed=True), seed % (1 << 64))
    return seed - (1 << 64) if seed >> 63 else seed


def plain_copies(docs, seed=17):
    """docs: [(doc_id, text, source)], no id twice -> {doc_id: copies}, by a plain loop over the meetings."""
    sizes, by_source = collections.Counter(), collections.defaultdict(list)
    for i, t, s in docs:
        sizes[s] += len((t or "").encode().split())
    targets = plain_targets(sizes)
    for i, t, s in docs:
        share = targets[s] / sizes[s] if sizes[s] else 0.0
        by_source[s].append((spark_hash((i, 8), (spark_hash_text(t), 8), (seed, 4)), i, len(t.encode().split()), share))
    out = {}
    for units in by_source.values():
        out |= {i: math.floor(x) for _, i, _, x in units}
        open_ = [[k, i, float(s), x - out[i]] for k, i, s, x in units if s > 0 and x > out[i]]
        blocks, level = -(-len(units) // mixing.FAN), 0
        while open_:
            dealt = collections.defaultdict(list)
            for item in open_:
                dealt[spark_hash((seed + level, 4), (item[0], 8)) % blocks].append(item)
            open_ = []
            for items in dealt.values():
                items.sort()
                cur = list(items[0])
                for e in map(list, items[1:]):
                    s, p, t, q = cur[2], cur[3], e[2], e[3]
                    down, up = min(s * p, t * (1 - q)), min(s * (1 - p), t * q)  # words that can move from cur, and to it
                    u = (spark_hash((seed, 4), (level, 4), (cur[0], 8), (e[0], 8)) % (1 << 64) >> 11) * 2.0**-53
                    if u < down / (up + down):
                        if s * (1 - p) <= t * q:
                            out[cur[1]] += 1
                            cur = [*e[:3], min(1.0, max(0.0, q - s * (1 - p) / t))]
                        else:
                            cur[3] = min(1.0, max(0.0, p + t * q / s))
                    elif s * p <= t * (1 - q):
                        cur = [*e[:3], min(1.0, max(0.0, q + s * p / t))]
                    else:
                        out[e[1]] += 1
                        cur[3] = min(1.0, max(0.0, p - t * (1 - q) / s))
                open_.append(cur)
            if blocks <= 1:
                (cur,) = open_
                out[cur[1]] += cur[3] >= 0.5
                break
            blocks, level = -(-blocks // mixing.FAN), level + 1
    return out


def test_taken_equals_plain_rounding(spark, sf):
    """The query, row by row."""
    want = plain_copies([(r.doc_id, r.text, r.source) for r in table(spark, sf, "documents").collect()])
    rows = op5_mixing(spark, sf).collect()
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: want[r.doc_id] * r.size for r in rows}
    assert {r.doc_id: r.copies for r in mixing.plan(table(spark, sf, "documents")).collect()} == want


def spark_hash_text(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h
