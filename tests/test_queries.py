"""Every registered query with SQL equals the oracle; the others run."""

import datetime as dt
import zlib
from functools import partial

import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.operators import windows
from millrace.plans import catalogue, relational
from millrace.sources.tables import table
from tests.oracle import compare

NAMES = sorted(catalogue.queries())


@pytest.mark.parametrize("name", [n for n in NAMES if n in catalogue.oracle_sql()])
def test_oracle(spark, sf, name):
    compare(catalogue.queries()[name](spark, sf), catalogue.oracle_sql()[name], sf)


@pytest.mark.parametrize("name", [n for n in NAMES if n not in catalogue.oracle_sql()])
def test_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = catalogue.queries()["scan_parquet"](spark, sf)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in plan and "o_custkey" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("name, of, key", [("merge_upsert", "part", "p_partkey"), ("merge_conditional", "part", "p_partkey"), ("merge_insert_list", "customer", "c_custkey")])
def test_merges_into_tables_that_hold_the_new_keys(spark, sf, tmp_path, name, of, key):
    """Keys of a larger table: what is to be inserted has the key of a row that is there."""
    rows = table(spark, sf, of)
    rows.unionByName(rows.withColumn(key, F.col(key) + 1000000)).coalesce(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / f"{of}.parquet")
    compare(catalogue.queries()[name](spark, str(tmp_path)), catalogue.oracle_sql()[name], str(tmp_path))


def test_the_first_of_equal_prices_counts(spark, tmp_path):
    """In any order of rows; orders without a key don't count, as for the oracle."""
    rows = [(7, 1, 5.0), (3, 1, 5.0), (4, 1, 2.0), (9, 1, 2.0), (None, 1, 9.0), (8, 1, None), (1, 2, None), (6, None, 1.0), (2, None, 1.0)]
    for k, order in enumerate((rows, rows[::-1])):
        spark.createDataFrame(order, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(str(tmp_path / f"{k}/orders.parquet"))
        got = {r.o_custkey: (r.dearest, r.cheapest) for r in catalogue.queries()["agg_maxby"](spark, str(tmp_path / str(k))).collect()}
        assert got == {1: (3, 4), 2: (None, None), None: (2, 2)}


def test_means_add_up_in_order_of_the_events(spark, tmp_path):
    """0.3 + 0.2 + 0.1 is less than 0.1 + 0.2 + 0.3 in doubles, and 0.2 lies between their thirds."""
    first, second = (0.1, 0.2, 0.3), (0.3, 0.2, 0.1)
    rows = [(3 * u + k, u, v) for u in range(40) for k, v in enumerate((first, second)[u % 2])]
    want = sorted(e for e, u, v in rows if v > (0.0 + (first, second)[u % 2][0] + (first, second)[u % 2][1] + (first, second)[u % 2][2]) / 3)
    assert len(want) == 60
    for k, order in enumerate((rows, rows[::-1])):
        spark.createDataFrame(order, "event_id long, user_id long, value double").coalesce(1).write.parquet(str(tmp_path / f"{k}/events.parquet"))
        assert sorted(r.event_id for r in catalogue.queries()["win_qualify"](spark, str(tmp_path / str(k))).collect()) == want


@pytest.mark.parametrize("name", ["agg_median", "win_rank"])
def test_large_groups_are_many_tasks(spark, sf, monkeypatch, name):
    """In stretches of 100 rows the result is the same, and none of them is left out or ranked alone."""
    monkeypatch.setattr(relational, "running", partial(windows.running, rows=100))
    monkeypatch.setattr(relational, "percentiles", partial(windows.percentiles, rows=100))
    df = catalogue.queries()[name](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "__chunk" in plan and "percentile(" not in plan
    compare(df, catalogue.oracle_sql()[name], sf)


def test_top_k_per_group_is_cut_before_the_shuffle(spark, sf):
    plan = catalogue.queries()["win_topn_group"](spark, sf)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_no_nested_loops(spark, sf):
    for name in ("join_range", "join_overlap", "join_asof"):
        plan = catalogue.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_not_in_broadcasts_one_row(spark, sf):
    """Spark's own NOT IN sends the whole subquery through the driver, whatever its size."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.queries()["join_not_in"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan and plan.count("BroadcastExchange") == 1


def test_functions_without_an_oracle_by_value(spark, sf):
    """What the oracle lacks, against Python's own libraries."""
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    for r in catalogue.queries()["fn_hash_more"](spark, sf).collect():
        raw = texts[r.doc_id].encode()
        assert r.c == zlib.crc32(raw) and r.x % (1 << 64) == xxhash.xxh64_intdigest(raw, 42) and r.h == murmur(raw) and r.same
    names = {r.c_custkey: r.c_name for r in table(spark, sf, "customer").select("c_custkey", "c_name").collect()}
    for r in catalogue.queries()["fn_string_more"](spark, sf).collect():
        name = names[r.c_custkey]
        assert (r.sx, r.lo, r.en, bytes(r.un), r.ub) == (soundex(name), name.find("0", 4) + 1, name, name.encode(), name)
    times = {r.event_id: r.ts for r in table(spark, sf, "events").select("event_id", "ts").collect()}
    for r in catalogue.queries()["fn_date_more"](spark, sf).collect():
        ts = times[r.event_id]
        months = (ts.year - 2023) * 12 + ts.month - 1 + (ts.day - 1) / 31
        assert r.today and r.now and r.fu == dt.datetime.fromtimestamp(r.event_id, dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        assert r.tz == ts + dt.timedelta(hours=9) and r.mb == pytest.approx(months, abs=1e-7) and r.iv == "2 days" and r.ta.replace(tzinfo=None) == ts + dt.timedelta(minutes=5)


def murmur(data, seed=42):
    """Murmur3 in 32 bits as Spark has it: the bytes after the last whole word go in one by one, sign-extended."""
    h = seed

    def turn(x, n):
        return (x << n | x >> (32 - n)) & 0xFFFFFFFF

    words = [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data) - len(data) % 4, 4)]
    for k in words + [b - 256 & 0xFFFFFFFF if b > 127 else b for b in data[len(data) - len(data) % 4 :]]:
        h ^= turn(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        h = turn(h, 13) * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= len(data)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * by & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def soundex(word):
    codes = {c: str(k) for k, cs in enumerate(("bfpv", "cgjkqsxz", "dt", "l", "mn", "r"), 1) for c in cs}
    out, last = word[0].upper(), codes.get(word[0].lower())
    for c in word[1:].lower():
        code = codes.get(c)
        if code and code != last:
            out += code
        if c not in "hw":
            last = code
    return (out + "000")[:4]


def test_approximate_aggregates_are_near(spark, sf):
    rows = {r.l_returnflag: r for r in catalogue.queries()["agg_approx"](spark, sf).collect()}
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_partkey", "l_quantity").collect()
    for flag, r in rows.items():
        mine = [x for x in lines if x.l_returnflag == flag]
        assert r.orders == pytest.approx(len({x.l_orderkey for x in mine}), rel=0.15) and r.parts == pytest.approx(len({x.l_partkey for x in mine}), rel=0.1)
        quantities = sorted(x.l_quantity for x in mine)
        assert all(abs(q - quantities[int(len(mine) * s)]) <= 1 for q, s in zip(r.quartiles, (0.25, 0.5, 0.75)))
        assert sum(b.y for b in r.histogram) == len(mine)
    found = catalogue.queries()["sample_rows"](spark, sf)
    assert 0 < found.count() and found.distinct().count() == found.count()
