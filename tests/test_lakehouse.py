"""The semantics of tables, one test for each rule, and the scenarios."""

import datetime as dt
import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.access import AccessDenied, AccessPolicy
from millrace.plans.engine import Engine
from millrace.service import Service, server
from millrace.settings import Settings, catalog_options
from millrace.sources import lakehouse
from millrace.sources.lakehouse import Catalog, CommitConflict, NoSuchNamespace, NoSuchTable
from millrace.sources.place import LocalPlace, StorePlace
from millrace.sources.pruning import Filter
from millrace.sources.schema import SchemaError
from millrace.sources.storage import ObjectStore

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.StringType(), False),
        T.StructField("user_id", T.StringType(), False),
        T.StructField("event_timestamp", T.TimestampNTZType(), False),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def at(minute):
    return dt.datetime(2023, 1, 1, 10, minute, tzinfo=dt.timezone.utc)


@pytest.fixture
def catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "warehouse"))
    c.create_namespace("default")
    return c


@pytest.fixture
def numbers(catalog):
    t = catalog.create_table("default.n", T.StructType([T.StructField("k", T.LongType(), False), T.StructField("v", T.DoubleType()), T.StructField("s", T.StringType())]))
    return t.append(pd.DataFrame({"k": [1, 2, 3, 4], "v": [1.0, None, 3.0, 4.0], "s": ["a", "b", None, "d"]}))


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_evolution_scenario(catalog):
    t = catalog.create_table("default.user_events", EVENTS, overwrite=True)
    t.append(pd.DataFrame({"event_id": ["e001", "e002"], "user_id": ["u001", "u002"], "event_timestamp": [at(0), at(5)], "event_type": ["login", "view_product"], "value": [1.0, 2.5]}))
    assert t.scan().count() == 2
    t.evolve({"source_ip": T.StringType()})
    t = catalog.load_table("default.user_events")
    t.append(pd.DataFrame({"event_id": ["e003", "e004"], "user_id": ["u003", "u001"], "event_timestamp": [at(10), at(15)], "event_type": ["logout", "add_to_cart"], "value": [0.0, 5.0], "source_ip": ["192.168.1.10", "192.168.1.11"]}))
    assert values(t.scan(), "event_id", "source_ip") == [("e001", None), ("e002", None), ("e003", "192.168.1.10"), ("e004", "192.168.1.11")]
    total = t.scan().agg(F.sum("value").alias("s"), F.count_distinct("user_id").alias("u"), F.min("event_timestamp").alias("t")).first()
    assert (total.s, total.u, total.t) == (8.5, 3, dt.datetime(2023, 1, 1, 10, 0))


def test_namespaces(catalog):
    assert catalog.create_namespace("test_db") and not catalog.create_namespace("test_db")
    assert catalog.create_namespace(("my_db", "staging"))
    assert catalog.list_namespaces() == [("default",), ("my_db",), ("test_db",)]
    assert catalog.list_namespaces("my_db") == [("my_db", "staging")]
    assert catalog.list_tables("test_db") == [] and catalog.list_tables("nowhere") == []
    with pytest.raises(NoSuchNamespace):
        catalog.create_table("nowhere.t", EVENTS)
    with pytest.raises(ValueError):
        catalog.create_namespace("../x")


def test_create_load_drop(catalog):
    t = catalog.create_table("default.t", EVENTS, properties={"owner": "me"})
    assert t.properties == {"format-version": "2", "owner": "me"}
    assert catalog.create_table("default.t", T.StructType([T.StructField("x", T.LongType())])).schema == EVENTS
    assert catalog.create_table("default.t", T.StructType([T.StructField("x", T.LongType())]), overwrite=True).schema.names == ["x"]
    assert catalog.create_table("default.new", EVENTS, overwrite=True).scan().count() == 0
    with pytest.raises(NoSuchTable):
        catalog.load_table("default.none")
    assert catalog.drop_table("default.t") and not catalog.drop_table("default.t")
    assert catalog.list_tables("default") == [("default", "new")]
    catalog.rename_table("default.new", "default.newer")
    assert catalog.list_tables("default") == [("default", "newer")]


def test_given_properties_stay_and_location_is_used(catalog, tmp_path):
    given_ = {"a": "b"}
    t = catalog.create_table("default.t", EVENTS, properties=given_, location=str(tmp_path / "elsewhere"))
    assert given_ == {"a": "b"} and t.location == str(tmp_path / "elsewhere")
    assert catalog.create_table("default.t1", EVENTS, properties={"format-version": "1"}).properties["format-version"] == "1"


def test_append_goes_by_name_and_checks(numbers, spark):
    numbers.append(spark.createDataFrame([("z", 9, 1.5, True)], "s string, k long, v double, extra boolean"))
    assert ("z",) in values(numbers.scan().where("k = 9"), "s")
    with pytest.raises(SchemaError):
        numbers.append(spark.createDataFrame([("z", 9, 1.5, True)], "s string, k long, v double, extra boolean"), strict=True)
    with pytest.raises(KeyError):
        numbers.append(spark.createDataFrame([(1, 1.0)], "k long, v double"))
    numbers.append(spark.createDataFrame([(10,)], "k int"), fill_missing=True)
    with pytest.raises(Exception, match="k is required"):
        numbers.append(spark.createDataFrame([(None, 1.0, "x")], "k long, v double, s string"))
    for schema in ("k string, v double, s string", "k long, v string, s string", "k long, v double, s int", "k double, v double, s string"):
        with pytest.raises(SchemaError):
            numbers.append(spark.createDataFrame([], schema))
    assert numbers.scan().count() == 6
    numbers.append(spark.createDataFrame([(7, 2, "i")], "k int, v int, s string"))
    assert values(numbers.scan().where("k = 7"), "v") == [(2.0,)]


def test_pandas_nan_zones_and_nanoseconds(catalog):
    t = catalog.create_table("default.t", T.StructType([T.StructField("v", T.DoubleType()), T.StructField("t", T.TimestampNTZType())]))
    zone = dt.timezone(dt.timedelta(hours=2))
    t.append(pd.DataFrame({"v": [np.nan, 1.0], "t": [dt.datetime(2024, 1, 1, 12, tzinfo=zone), None]}))
    assert values(t.scan(), "v", "t") == [(1.0, None), (None, dt.datetime(2024, 1, 1, 10))]
    with pytest.raises(SchemaError):
        t.append(pd.DataFrame({"v": [1.0], "t": pd.array([1], dtype="int64").astype("datetime64[ns]")}))


def test_append_isnt_idempotent_but_batches_are(numbers, spark):
    row = spark.createDataFrame([(5, 5.0, "e")], "k long, v double, s string")
    numbers.append(row).append(row)
    assert numbers.scan().count() == 6
    numbers.append(row, batch_id="b1").append(row, batch_id="b1")
    assert numbers.scan().count() == 7


def test_evolution_rules(numbers):
    with pytest.raises(SchemaError):
        numbers.evolve({"fine": T.LongType(), "V": T.LongType()})
    assert "fine" not in numbers.refresh().schema.names
    with pytest.raises(NotImplementedError):
        numbers.evolve({"x": T.LongType()}, method="drop_columns")
    old = numbers.catalog.load_table("default.n")
    numbers.rename_column("v", "w").drop_column("s").evolve({"s": T.StringType()})
    assert values(numbers.scan(), "k", "w", "s") == [(1, 1.0, None), (2, None, None), (3, 3.0, None), (4, 4.0, None)]
    assert old.scan().columns == ["k", "v", "s"] and old.scan().count() == 4  # a handle is a snapshot


def test_delete_and_update_leave_unknown_rows(numbers):
    numbers.delete("v > 2")
    assert values(numbers.scan(), "k") == [(1,), (2,)]
    numbers.update({"s": "concat(s, '!')", "v": "k * 10"}, "v < 5")
    assert values(numbers.scan(), "k", "v", "s") == [(1, 10.0, "a!"), (2, None, "b")]
    numbers.delete("true")
    assert numbers.scan().count() == 0
    assert [r.operation for r in numbers.snapshots().collect()] == ["append", "delete", "update", "delete"]


def test_merge(numbers, spark):
    s = spark.createDataFrame([(1, 100.0, "x"), (4, None, "gone"), (9, 9.0, "new"), (None, 0.0, "null key")], "k long, v double, s string")
    numbers.merge(s.where("k IS NOT NULL"), ["k"], delete_when="s.s = 'gone'")
    assert values(numbers.scan(), "k", "v", "s") == [(1, 100.0, "x"), (2, None, "b"), (3, 3.0, None), (9, 9.0, "new")]
    with pytest.raises(ValueError):
        numbers.merge(s.unionByName(s).where("k = 1"), ["k"])
    numbers.merge(s.where("k = 77"), ["k"])
    assert numbers.scan().count() == 4


def test_merge_clauses_as_written(catalog, spark):
    e = Engine(spark, "", catalog=catalog)
    e.sql("CREATE TABLE default.t (id BIGINT NOT NULL, v BIGINT, at STRING)")
    e.sql("INSERT INTO default.t VALUES (1, 10, 'a'), (2, 20, 'b'), (3, 30, 'c')")
    spark.createDataFrame([(1, 1), (2, 99), (3, 5), (4, 50), (5, 7), (None, 60)], "id long, v long").createOrReplaceTempView("src")
    e.sql("MERGE INTO default.t t USING src s ON t.id = s.id WHEN MATCHED AND s.v > 50 THEN UPDATE SET v = s.v WHEN MATCHED AND s.v = 5 THEN DELETE WHEN NOT MATCHED AND s.v > 10 AND s.id IS NOT NULL THEN INSERT (id, v) VALUES (s.id, s.v * 2)")
    assert values(e.sql("SELECT * FROM default.t"), "id", "v", "at") == [(1, 10, "a"), (2, 99, "b"), (4, 100, None)]
    # Aliases the other way round, names in texts, a condition that isn't an equation of one name, several source rows of which one applies.
    spark.createDataFrame([(1, 500, "t.id THEN DELETE"), (1, 2, "x"), (40, 1, "y")], "key long, v long, w string").createOrReplaceTempView("src")
    e.sql("MERGE INTO default.t AS s USING src AS t ON s.id = t.key WHEN MATCHED AND t.v > 100 THEN UPDATE SET s.at = concat(t.w, ' WHEN MATCHED'), v = s.v + t.v WHEN NOT MATCHED THEN INSERT VALUES (t.key, t.v, NULL)")
    assert values(e.sql("SELECT * FROM default.t"), "id", "v", "at") == [(1, 510, "t.id THEN DELETE WHEN MATCHED"), (2, 99, "b"), (4, 100, None), (40, 1, None)]
    for bad in (
        "WHEN NOT MATCHED BY SOURCE THEN DELETE",
        "WHEN MATCHED THEN INSERT *",
        "WHEN NOT MATCHED THEN DELETE",
        "WHEN MATCHED THEN UPDATE SET v",
        "WHEN NOT MATCHED THEN INSERT (id) VALUES (t.key, 1)",
        "WHEN MATCHED THEN DELETE nonsense",
        "WHEN MATCHED THEN UPDATE SET nothing = 1",
    ):
        with pytest.raises((ValueError, SchemaError)):
            e.sql(f"MERGE INTO default.t AS s USING src AS t ON s.id = t.key AND t.v > 100 {bad}")
    with pytest.raises(ValueError, match="two source rows"):
        e.sql("MERGE INTO default.t AS s USING src AS t ON s.id = t.key WHEN MATCHED THEN DELETE")
    assert e.sql("SELECT * FROM default.t").count() == 4


def test_merge_meets_a_concurrent_append(numbers, spark, monkeypatch):
    """A key that another writer adds while the merge is worked out isn't inserted twice."""
    write, other = lakehouse.Table._write, numbers.catalog.load_table("default.n")
    late = [spark.createDataFrame([(9, 1.0, "other")], "k long, v double, s string")]

    def slow(self, df):
        found = write(self, df)
        if self is numbers and late:
            other.append(late.pop())
        return found

    monkeypatch.setattr(lakehouse.Table, "_write", slow)
    numbers.merge(spark.createDataFrame([(9, 90.0, "merged"), (1, 10.0, "merged")], "k long, v double, s string"), ["k"])
    assert [r for r in values(numbers.refresh().scan(), "k", "v", "s") if r[0] in (1, 9)] == [(1, 10.0, "merged"), (9, 90.0, "merged")]
    late.append(spark.createDataFrame([(10, 1.0, "other")], "k long, v double, s string"))
    with pytest.raises(CommitConflict):
        numbers.merge(spark.createDataFrame([(10, 90.0, "merged")], "k long, v double, s string"), ["k"], attempts=1)


def test_metadata_stays_small(numbers, spark):
    row = spark.createDataFrame([(5, 5.0, "e")], "k long, v double, s string")
    for k in range(4):
        numbers.append(row, batch_id=("stream", k)).append(row, batch_id=("stream", max(0, k - 1)))
    assert numbers.scan().count() == 8 and numbers.meta["batches"] == {"main/stream": 3}
    numbers.create_ref("kept", 1).expire_snapshots(2)
    assert [r.snapshot_id for r in numbers.snapshots().collect()] == [1, 4, 5]
    numbers.append(row)
    assert numbers.meta["refs"]["main"] == 6 and numbers.scan().count() == 9 and numbers.scan(ref="kept").count() == 4
    with pytest.raises(LookupError):
        numbers.scan(snapshot_id=3)


def test_a_taken_location_stays(catalog, tmp_path):
    place = str(tmp_path / "place")
    catalog.create_table("default.t", EVENTS, location=place)
    with pytest.raises(ValueError):
        catalog.create_table("default.u", EVENTS, location=place)


def test_places(spark, tmp_path):
    local = LocalPlace(tmp_path / "a")
    store = StorePlace(spark, f"file://{tmp_path}/b")  # Spark's own file systems, over local files
    for place in (local, store):
        place.make_folder()
        (place / "x").replace("{}")
        (place / "x").replace('{"é": 1}')
        (place / "in" / "deep").make_folder()
        (place / "in" / "deep" / "y.parquet").replace("")
        assert (place / "x").read() == '{"é": 1}' and sorted(n for n in place.names() if not n.endswith(".crc")) == ["in", "x"]
        assert [f.rsplit("/", 1)[1] for f in place.files(".parquet")] == ["y.parquet"] and (place / "in").parent.name == place.name
        (place / "in").remove()
        (place / "none").remove()
        assert not (place / "in").exists() and (place / "none").names() == []
    (local / "z").create("1")
    with pytest.raises(FileExistsError):
        (local / "z").create("2")
    assert (local / "z").read() == "1" and sorted(local.names()) == ["x", "z"]
    with pytest.raises(NotImplementedError):
        (store / "z").create("1")  # a store that can't create exclusively is refused


def test_a_warehouse_by_another_scheme(spark, tmp_path):
    """A mounted name resolves to its folder; tables are read and committed there."""
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.lake.link./w", f"file://{tmp_path}")
    c = Catalog(spark, "viewfs://lake/w/house")
    c.create_namespace("default")
    t = c.create_table("default.t", T.StructType([T.StructField("x", T.LongType())]))
    t.append(spark.range(4).toDF("x")).delete("x = 2")
    assert values(c.load_table("default.t").scan(), "x") == [(0,), (1,), (3,)] and str(c.root) == f"{tmp_path}/house"


def test_other_catalogs(catalog, spark, tmp_path):
    e = Engine(spark, "", catalog=catalog)
    e.sql(f"CREATE CATALOG other USING lake WITH (warehouse = '{tmp_path}/other')")
    e.sql(f"CREATE CATALOG IF NOT EXISTS other USING lake WITH (\"warehouse\" = '{tmp_path}/other')")
    e.sql("CREATE TABLE other.sales.t AS SELECT id AS x FROM range(5)")
    e.sql("CREATE TABLE default.t AS SELECT id AS x FROM range(3)")
    e.sql("MERGE INTO other.sales.t AS t USING default.t AS s ON t.x = s.x WHEN MATCHED THEN UPDATE SET x = t.x + 100")
    e.sql("INSERT INTO other.sales.t SELECT x + 50 FROM main.default.t")
    assert sorted(r.x for r in e.sql("SELECT t.x FROM other.sales.t").collect()) == [3, 4, 50, 51, 52, 100, 101, 102]
    later = Engine(spark, "", catalog=Catalog(spark, str(catalog.root)))
    assert later.sql("SELECT * FROM other.sales.t JOIN default.t b ON t.x = b.x + 50").count() == 3
    assert values(later.sql("SHOW CATALOGS"), "catalog") == [("main",), ("other",)] and values(later.sql("SHOW TABLES IN other.sales"), "table") == [("t",)]
    assert values(later.sql("SHOW SCHEMAS FROM other"), "namespace") == [("sales",)]
    with pytest.raises(ValueError):
        e.sql(f"CREATE CATALOG other USING lake WITH (warehouse = '{tmp_path}/more')")
    later.sql("DROP CATALOG other")
    with pytest.raises(LookupError):
        later.sql("DROP CATALOG other")
    assert values(later.sql("SHOW CATALOGS"), "catalog") == [("main",)]


def test_partitions_get_few_files(catalog, spark):
    t = catalog.create_table("default.t", T.StructType([T.StructField("d", T.LongType()), T.StructField("x", T.LongType())]), [("d", "identity")])
    t.append(spark.range(4000).selectExpr("id % 10 AS d", "id AS x").repartition(16))
    assert len(t.files(t.snapshot())) <= 20 and t.scan().count() == 4000


def test_files_by_path_and_fetch_first(catalog, spark, tmp_path):
    e = Engine(spark, "", catalog=catalog)
    spark.range(10).write.parquet(str(tmp_path / "raw.files"))
    assert e.sql(f"SELECT count(*) AS n FROM parquet.`{tmp_path}/raw.files`").first().n == 10
    e.sql("CREATE TABLE default.t AS SELECT * FROM range(20)")
    assert values(e.sql("SELECT id, 'FETCH FIRST 1 ROWS ONLY' AS t FROM default.t ORDER BY id OFFSET 2 ROWS FETCH NEXT 3 ROWS ONLY"), "id") == [(2,), (3,), (4,)]
    assert e.sql("SELECT id FROM default.t ORDER BY id FETCH FIRST ROW ONLY").collect() == [(0,)]


def test_time_travel_refs_and_compaction(numbers, spark):
    for k in range(5, 9):
        numbers.append(spark.createDataFrame([(k, 1.0, "z")], "k long, v double, s string"))
    assert numbers.scan(snapshot_id=1).count() == 4 and numbers.scan().count() == 8
    numbers.create_ref("dev").append(spark.createDataFrame([(50, 1.0, "z")], "k long, v double, s string"), ref="dev")
    assert numbers.scan(ref="dev").count() == 9 and numbers.scan().count() == 8
    n = len(numbers.files(numbers.snapshot()))
    numbers.compact()
    assert len(numbers.files(numbers.snapshot())) < n and numbers.scan().count() == 8
    numbers.set_ref("main", 1)
    assert numbers.scan().count() == 4
    with pytest.raises(LookupError):
        numbers.scan(snapshot_id=99)


def test_two_writers_lose_nothing(numbers, spark):
    def add(k):
        numbers.catalog.load_table("default.n").append(spark.createDataFrame([(k, 0.0, "t")], "k long, v double, s string"))

    threads = [threading.Thread(target=add, args=(k,)) for k in range(100, 106)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert numbers.refresh().scan().count() == 10


def test_a_change_of_a_file_that_is_gone_conflicts(numbers):
    files = numbers.files(numbers.snapshot())
    numbers.delete("k = 1")
    with pytest.raises(CommitConflict):
        numbers._replace(files, None, "delete", "main")


def test_data_without_a_commit_isnt_seen(numbers, spark, monkeypatch):
    def fail(*a, **k):
        raise OSError("lost")

    monkeypatch.setattr(lakehouse, "_create", fail)
    with pytest.raises(OSError):
        numbers.append(spark.createDataFrame([(5, 5.0, "e")], "k long, v double, s string"))
    assert numbers.refresh().scan().count() == 4


FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
OPS = st.sampled_from(["=", "<", "<=", ">", ">=", "is null", "is not null"])


@FEW
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 5)), st.one_of(st.none(), st.floats(allow_nan=True, width=32))), min_size=1, max_size=10), op=OPS, value=st.integers(-5, 5), column=st.sampled_from(["a", "b"]))
def test_skipping_files_changes_nothing(spark, tmp_path_factory, rows, op, value, column):
    c = Catalog(spark, str(tmp_path_factory.mktemp("w")))
    c.create_namespace("d")
    t = c.create_table("d.t", T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.FloatType())]), [("a", "identity")])
    t.append(spark.createDataFrame(rows, "a int, b float").repartition(3))
    f = Filter(column, op, None if "null" in op else value if column == "a" else float(value))
    assert sorted(map(str, t.scan(filters=[f]).collect())) == sorted(map(str, t.scan().where(f.expression()).collect()))
    t.delete("a > 0")
    want = [r for r in rows if not (r[0] is not None and r[0] > 0)]
    assert t.scan().count() == len(want)


def test_day_partitions_are_hidden_and_pruned(catalog, spark):
    t = catalog.create_table("default.t", EVENTS, [("event_timestamp", "day"), ("user_id", "bucket[4]")])
    rows = [(f"e{d}", f"u{d}", dt.datetime(2024, 1, d), None, 1.0) for d in range(1, 10)]
    t.append(spark.createDataFrame(rows, EVENTS))
    assert t.scan().columns == EVENTS.names
    found = t.scan(filters=[Filter("event_timestamp", "<", dt.datetime(2024, 1, 3))])
    assert found.count() == 2 and len(found.inputFiles()) <= 3


def test_sql(catalog, spark, tmp_path):
    e = Engine(spark, "", catalog=catalog)
    e.sql("CREATE TABLE default.a (id BIGINT NOT NULL, amount DECIMAL(10, 2), day DATE) PARTITIONED BY (months(day))")
    e.sql("INSERT INTO default.a VALUES (1, 1.5, DATE '2024-01-01'), (2, 2.5, DATE '2024-02-01'), (3, NULL, NULL)")
    e.sql("INSERT INTO default.a (id) VALUES (4)")
    assert e.sql("SELECT count(*) AS n FROM default.a").first().n == 4
    assert e.sql("SELECT a.id, 'default.a' AS t FROM default.a WHERE a.id IN (SELECT id FROM default.a x WHERE x.amount > 2)").collect() == [(2, "default.a")]
    assert e.sql("WITH q AS (SELECT * FROM default.a) SELECT count(*) AS n FROM q JOIN default.a b ON q.id = b.id").first().n == 4
    e.sql("DELETE FROM default.a WHERE amount < 2")
    e.sql("UPDATE default.a SET amount = amount + 1 WHERE id = 2")
    assert values(e.sql("SELECT id, CAST(amount AS STRING) AS amount FROM default.a"), "id", "amount") == [(2, "3.50"), (3, None), (4, None)]
    assert e.sql("SELECT count(*) AS n FROM default.a VERSION AS OF 2").first().n == 4
    e.sql("CREATE OR REPLACE TABLE default.b AS SELECT id FROM default.a")
    e.sql("ALTER TABLE default.b ADD COLUMNS (x INT, y DECIMAL(5,1))")
    assert e.sql("SELECT * FROM default.b").columns == ["id", "x", "y"]
    e.sql("DROP TABLE IF EXISTS default.none")
    with pytest.raises(LookupError):
        e.sql("DROP TABLE default.none")
    with pytest.raises(ValueError):
        e.sql("CREATE TABLE default.b (x INT)")
    assert values(e.sql("SHOW TABLES IN default"), "table") == [("a",), ("b",)]


def test_access_rules(catalog, spark, tmp_path):
    rules = {
        "catalogs": [{"user": "reader", "catalog": "main", "allow": "read-only"}, {"user": "admin", "catalog": ".*", "allow": "all"}],
        "schemas": [{"user": "admin", "owner": True}],
        "tables": [{"user": "reader", "schema": "default", "table": "n", "privileges": ["SELECT", "INSERT"]}, {"user": "admin", "privileges": ["OWNERSHIP"]}],
        "functions": [{"user": "admin", "function": ".*", "privileges": ["EXECUTE"]}],
        "queries": [{"user": "admin|reader", "allow": ["execute"]}],
    }
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(rules))
    policy = AccessPolicy(str(path), refresh=0)
    Engine(spark, "", policy, "admin", catalog).sql("CREATE TABLE default.n (x INT)")
    reader = Engine(spark, "", policy, "reader", catalog)
    assert reader.sql("SELECT * FROM default.n").count() == 0
    for text in ("INSERT INTO default.n VALUES (1)", "DROP TABLE default.n", "DELETE FROM default.n"):
        with pytest.raises(AccessDenied):
            reader.sql(text)
    with pytest.raises(AccessDenied):
        Engine(spark, "", policy, "nobody", catalog).sql("SELECT * FROM default.n")
    for text in ("CREATE NAMESPACE mine", "DROP NAMESPACE default", "CREATE TABLE mine.t (x INT)"):
        with pytest.raises(AccessDenied):
            reader.sql(text)
    admin = Engine(spark, "", policy, "admin", catalog)
    admin.sql("CREATE NAMESPACE theirs")
    admin.sql("CREATE TABLE theirs.t (x INT)")
    assert values(reader.sql("SHOW NAMESPACES"), "namespace") == [("default",)] and reader.sql("SHOW TABLES IN theirs").count() == 0
    assert ("t",) in values(admin.sql("SHOW TABLES IN theirs"), "table")
    with pytest.raises(AccessDenied):
        Engine(spark, "", policy, "nobody", catalog).sql("SHOW NAMESPACES")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION twice(x INT) RETURNS INT RETURN x * 2")
    assert admin.sql("SELECT twice(x) AS y, upper('a') AS u FROM default.n").count() == 0
    assert reader.sql("SELECT upper('a') AS u FROM default.n").count() == 0
    for text in ("SELECT twice(x) AS y FROM default.n", "SELECT 1 AS x WHERE EXISTS (SELECT 1 FROM default.n WHERE twice(x) > 1)"):
        with pytest.raises(AccessDenied):
            reader.sql(text)
    assert policy.owns_schema("admin", "main", "default") and not policy.owns_schema("reader", "main", "default")
    assert policy.may_call("admin", "main", "f") and not policy.may_call("reader", "main", "f")
    path.write_text("{}")
    assert reader.sql("SELECT * FROM default.n").count() == 0 and policy.allows("any", "main", "s", "t", "DELETE")


def test_objects(spark, tmp_path):
    store = ObjectStore(str(tmp_path / "store"))
    assert store.ensure_bucket("b") and not store.ensure_bucket("b")
    (tmp_path / "up.txt").write_bytes(b"one line\n")
    store.upload(str(tmp_path / "up.txt"), "b", "test_files/dummy.txt")
    store.download("b", "test_files/dummy.txt", str(tmp_path / "down.txt"))
    assert (tmp_path / "down.txt").read_bytes() == b"one line\n"
    assert store.objects(spark, "b").first().length == 9
    store.remove("b", "test_files/dummy.txt")
    with pytest.raises(FileNotFoundError):
        store.download("b", "test_files/dummy.txt", str(tmp_path / "x"))
    for bad in (("b", "../../x"), ("..", "x"), ("", "x")):
        with pytest.raises(ValueError):
            store.upload(str(tmp_path / "up.txt"), *bad)


def test_settings(tmp_path):
    s = Settings.from_env({"MILLRACE_PORT": "9", "MILLRACE_APP_ENV": "production"})
    assert s.port == 9 and s.is_production and not Settings.from_env({}).is_production
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"catalogs": {"main": {"warehouse": "w"}}}))
    assert catalog_options("main", str(path)) == {"warehouse": "w"}
    with pytest.raises(ValueError):
        catalog_options("other", str(path))
    with pytest.raises(FileNotFoundError):
        catalog_options("main", str(tmp_path / "none"))


def call(method, url):
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method=method)) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_http(spark, tmp_path):
    with pytest.raises(ValueError):
        Service(spark, Settings())
    (tmp_path / "file").write_text("")
    with pytest.raises((RuntimeError, NotADirectoryError)):
        Service(spark, Settings(storage_root=str(tmp_path / "file")))
    service = Service(spark, Settings(storage_root=str(tmp_path / "store")))
    http = server(service, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_address[1]}"
    try:
        assert call("GET", f"{base}/")[0] == 200
        assert call("GET", f"{base}/health") == (200, {"status": "ok", "catalog_name": "main"})
        assert call("GET", f"{base}/data")[0] == 500  # no table yet
        assert call("POST", f"{base}/data/a%20b?value=2.5")[0] == 200
        assert call("POST", f"{base}/data/c")[0] == 422
        status, body = call("GET", f"{base}/data")
        assert status == 200 and [(r["id"], r["value"]) for r in body["data"]] == [("a b", 2.5)]
        stamp = dt.datetime.fromisoformat(body["data"][0]["timestamp"])
        assert abs((dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) - stamp).total_seconds()) < 300
        assert call("GET", f"{base}/none")[0] == 404
        service.engine.catalog.root = service.engine.catalog.root / "gone" / "away"
        service.engine.catalog.list_namespaces = lambda: (_ for _ in ()).throw(OSError("down"))
        assert call("GET", f"{base}/health")[0] == 503
    finally:
        http.shutdown()
