import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import sharding
from millrace.llm.common import Shared
from millrace.llm.queries import OP4_SQL, op4_sharding
from millrace.llm.sharding import Conflict, Manifest, Shard, ShardStore
from tests.oracle import compare


def test_query_equals_the_oracle(spark, sf):
    compare(op4_sharding(spark, sf), OP4_SQL, sf)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=60))
def test_plans_merge_like_sizes_up_to_the_target(sizes):
    shards = [Shard(str(i), 1, s) for i, s in enumerate(sizes)]
    groups = sharding.plan_merges(shards, target=1000, fan=4)
    used = [s for g in groups for s in g]
    assert len(used) == len(set(used)) and set(used) <= set(shards)
    for g in groups:
        assert len(g) > 1 and sum(s.bytes for s in g) <= 1250
        assert all(sharding.tier(s.bytes, 1000) > 0 for s in g)


def test_compaction_ends_with_few_small_shards():
    rng = random.Random(2)
    shards = [Shard(str(i), 1, rng.randint(1, 200)) for i in range(500)]
    total, n = sum(s.bytes for s in shards), 0
    while groups := sharding.plan_merges(shards, 1000, 4):
        for g in groups:
            n += 1
            shards = [s for s in shards if s not in g] + [Shard(f"m{n}", len(g), sum(s.bytes for s in g))]
    assert sum(s.bytes for s in shards) == total
    assert len([s for s in shards if sharding.tier(s.bytes, 1000)]) < 16


def store(spark, **options):
    return ShardStore(spark, Shared.create(spark, "shard-test"), **options)


def test_versions_conflicts_and_vacuum(spark):
    s = store(spark, target=1 << 20, fan=2)
    df = spark.range(300).selectExpr("id", "cast(id AS string) AS text").repartition(3)
    assert [m.version for m in s.append(df, F.col("id") % 2)] == [1, 2]
    assert s.read(1).count() == 150 and s.read().count() == 300
    with pytest.raises(Conflict):
        s.commit(Manifest(2, None, []))
    assert s.compact().version == 3 and len(s.manifest().shards) == 1 and s.read().count() == 300
    assert s.read(2).count() == 300  # earlier versions can be read until they are vacuumed
    merged = s.manifest(2).shards
    with pytest.raises(Conflict):
        s._swap(merged, [], "compact")
    assert s.vacuum() == len(merged) and s.versions() == [3] and s.read().count() == 300
    assert s.compact().version == 3
    with pytest.raises(ValueError):
        s.append(spark.range(3))


def test_two_writers(spark):
    a = store(spark)
    b = ShardStore(spark, a.shared)
    a.append(spark.range(5))
    stale = b.manifest()
    a.append(spark.range(5, 9))
    with pytest.raises(Conflict):
        b.commit(Manifest(stale.version + 1, stale.schema, []))
    b.append(spark.range(9, 12))
    assert sorted(r.id for r in a.read().collect()) == list(range(12))


def test_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "long " * 100_000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __arrival int")
    s = sharding.shard_arrivals(df, F.col("doc_id") % 2)
    assert sorted(map(str, s.read().collect())) == sorted(map(str, df.collect()))
    empty = sharding.shard_arrivals(df.limit(0), F.lit(0))
    assert empty.manifest().version == 1 and empty.read().count() == 0 and empty.read().columns == df.columns


def test_files_of_a_dead_writer_go(spark):
    s = store(spark)
    s.append(spark.range(10))
    s.shared.write("data/lost/part-0.parquet", [b"half a file"])
    assert s.vacuum() == 0 and s.shared.exists("data/lost/part-0.parquet")  # its writer may still be at work
    assert s.vacuum(grace=-1) == 1 and not s.shared.exists("data/lost/part-0.parquet")
    assert s.read().count() == 10


def test_a_store_without_exclusive_names_is_refused(spark, monkeypatch):
    s = store(spark)

    class Other:
        type_name = "s3"

    monkeypatch.setattr(s.shared, "_fs", lambda name: (Other(), name))
    with pytest.raises(NotImplementedError):
        s.commit(Manifest(1, None, []))
