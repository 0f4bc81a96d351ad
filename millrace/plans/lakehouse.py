"""Queries over managed tables: every one makes its own warehouse, changes a table and reads it back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.catalogue import query
from millrace.plans.engine import Engine
from millrace.sources.lakehouse import Table
from millrace.sources.pruning import Filter
from millrace.sources.tables import read, table, write
from millrace.streaming.sink import write_table


def fresh_engine(spark: SparkSession) -> Engine:
    """A warehouse of its own in the folder that the cluster shares; a temporary one only where all run in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return Engine(spark, f"{root.rstrip('/')}/warehouse-{uuid.uuid4().hex}")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set, and a folder of this machine isn't seen by the others")
    return Engine(spark, tempfile.mkdtemp(prefix="warehouse-"))


def _managed(spark: SparkSession, sf_dir: str, name: str, partition_by: tuple[tuple[str, str], ...] = (), where: str = "true") -> tuple[Engine, Table]:
    engine = fresh_engine(spark)
    df = table(spark, sf_dir, name).where(where)
    engine.catalog.create_namespace("lake")
    made = engine.catalog.create_table(f"lake.{name}", df.schema, partition_by)
    return engine, made.append(df)


@query("scan_table", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE value > 1 GROUP BY event_type")
def scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, _ = _managed(spark, sf_dir, "events")
    return engine.sql("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM lake.events WHERE value > 1 GROUP BY event_type")


@query("scan_pruned", "SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def scan_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden day partitions: the files of other days aren't in the plan."""
    import datetime as dt

    _, events = _managed(spark, sf_dir, "events", (("ts", "day"),))
    return events.scan(["event_id", "ts", "value"], [Filter("ts", ">=", dt.datetime(2024, 1, 10)), Filter("ts", "<", dt.datetime(2024, 1, 12))])


@query("insert_append", "SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey + 1000000, upper(c_name) FROM customer WHERE c_nationkey = 3")
def insert_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, _ = _managed(spark, sf_dir, "customer")
    engine.sql("INSERT INTO lake.customer (c_custkey, c_name) SELECT c_custkey + 1000000, upper(c_name) FROM lake.customer WHERE c_nationkey = 3")
    return engine.sql("SELECT c_custkey, c_name FROM lake.customer")


@query("delete_rows", "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 50000)")
def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, _ = _managed(spark, sf_dir, "orders")
    engine.sql("DELETE FROM lake.orders WHERE o_orderstatus = 'F' AND o_totalprice > 50000")
    return engine.sql("SELECT o_orderkey, o_orderstatus FROM lake.orders")


@query("update_rows", "SELECT s_suppkey, CASE WHEN s_nationkey = 7 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal, CASE WHEN s_nationkey = 7 THEN lower(s_name) ELSE s_name END AS s_name FROM supplier")
def update_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, _ = _managed(spark, sf_dir, "supplier")
    engine.sql("UPDATE lake.supplier SET s_acctbal = s_acctbal * 2, s_name = lower(s_name) WHERE s_nationkey = 7")
    return engine.sql("SELECT s_suppkey, s_acctbal, s_name FROM lake.supplier")


@query(
    "merge_upsert",
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice FROM part WHERE NOT (p_size > 45)
       UNION ALL SELECT p_partkey + 1000000, p_retailprice + 1 FROM part WHERE p_size > 25 AND p_size <= 30""",
)
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows say so and match nothing: a table of over a million parts has their keys already."""
    engine, parts = _managed(spark, sf_dir, "part")
    old = table(spark, sf_dir, "part").withColumns({"p_retailprice": F.col("p_retailprice") + 1, "is_new": F.lit(False)}).where("p_size > 25")
    new = old.where("p_size <= 30").withColumns({"p_partkey": F.col("p_partkey") + 1000000, "is_new": F.lit(True)})
    old.unionByName(new).createOrReplaceTempView("changes")
    engine.sql(
        """MERGE INTO lake.part t USING changes s ON t.p_partkey = s.p_partkey AND NOT s.is_new
           WHEN MATCHED AND s.p_size > 45 THEN DELETE WHEN MATCHED THEN UPDATE SET p_retailprice = s.p_retailprice WHEN NOT MATCHED THEN INSERT *"""
    )
    return engine.sql("SELECT p_partkey, p_retailprice FROM lake.part")


@query(
    "merge_conditional",
    """SELECT p_partkey, CASE WHEN p_size > 45 THEN NULL WHEN p_size > 40 THEN 'large ' || p_brand WHEN p_size > 30 AND p_type <> 'PROMO' THEN lower(p_brand) ELSE p_brand END AS p_brand, CASE WHEN p_size > 40 AND p_size <= 45 THEN 0 ELSE p_size END AS p_size
       FROM part WHERE p_size <= 45
       UNION ALL SELECT p_partkey + 1000000, p_brand, p_size FROM part WHERE p_size > 48""",
)
def merge_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first clause that holds decides; rows for which none holds stay, or aren't inserted.  New rows match nothing, as in merge_upsert."""
    engine, parts = _managed(spark, sf_dir, "part")
    part = table(spark, sf_dir, "part")
    new = part.withColumns({"p_partkey": F.col("p_partkey") + 1000000, "is_new": F.lit(True)})
    part.where("p_size > 30").withColumn("is_new", F.lit(False)).unionByName(new).createOrReplaceTempView("part_changes")
    engine.sql(
        """MERGE INTO lake.part AS t USING part_changes AS s ON t.p_partkey = s.p_partkey AND NOT s.is_new
           WHEN MATCHED AND s.p_size > 45 THEN DELETE
           WHEN MATCHED AND s.p_size > 40 THEN UPDATE SET p_brand = concat('large ', t.p_brand), p_size = 0
           WHEN MATCHED AND CASE WHEN s.p_type = 'PROMO' THEN false ELSE true END THEN UPDATE SET t.p_brand = lower(s.p_brand)
           WHEN NOT MATCHED AND s.p_size > 48 THEN INSERT *"""
    )
    return engine.sql("SELECT p_partkey, p_brand, p_size FROM lake.part")


@query(
    "merge_insert_list",
    """SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
       UNION ALL SELECT c_custkey + 1000000, 'a, WHEN MATCHED', NULL, c_acctbal * 2, NULL FROM customer WHERE c_nationkey = 3
       UNION ALL SELECT c_custkey + 1000000, upper(c_name), c_nationkey, NULL, NULL FROM customer WHERE c_nationkey BETWEEN 4 AND 6""",
)
def merge_insert_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and values of an INSERT are taken as written; the others are null.  New rows match nothing, as in merge_upsert."""
    engine, _ = _managed(spark, sf_dir, "customer")
    table(spark, sf_dir, "customer").createOrReplaceTempView("known_customers")
    engine.sql(
        """MERGE INTO lake.customer USING (SELECT *, c_custkey + 1000000 AS new_key, true AS is_new FROM known_customers) new ON customer.c_custkey = new.new_key AND NOT new.is_new
           WHEN NOT MATCHED AND new.c_nationkey = 3 THEN INSERT (c_custkey, c_name, c_acctbal) VALUES (new.new_key, 'a, WHEN MATCHED', new.c_acctbal * 2)
           WHEN NOT MATCHED AND new.c_nationkey BETWEEN 4 AND 6 THEN INSERT (c_nationkey, c_name, c_custkey) VALUES (new.c_nationkey, upper(new.c_name), new.new_key)"""
    )
    return engine.sql("SELECT * FROM lake.customer")


@query("fetch_first", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7 OFFSET 3")
def fetch_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, _ = _managed(spark, sf_dir, "orders")
    return engine.sql("SELECT o_orderkey FROM lake.orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 3 ROWS FETCH FIRST 7 ROWS ONLY")


@query("ddl_roundtrip", "SELECT n_nationkey, n_name AS name, NULL::DOUBLE AS score FROM nation")
def ddl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fresh_engine(spark)
    table(spark, sf_dir, "nation").createOrReplaceTempView("source_nation")
    engine.sql("CREATE NAMESPACE IF NOT EXISTS lake")
    engine.sql("CREATE TABLE lake.n (n_nationkey INT NOT NULL, n_name STRING, n_regionkey INT)")
    engine.sql("INSERT INTO lake.n SELECT * FROM source_nation")
    engine.sql("ALTER TABLE lake.n ADD COLUMNS (score DOUBLE)")
    engine.sql("ALTER TABLE lake.n RENAME COLUMN n_name TO name")
    engine.sql("ALTER TABLE lake.n DROP COLUMN n_regionkey")
    engine.sql("CREATE TABLE lake.gone (x INT)")
    engine.sql("DROP TABLE lake.gone")
    return engine.sql("SELECT * FROM lake.n")


@query("ctas", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey")
def ctas(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, _ = _managed(spark, sf_dir, "orders")
    engine.sql("CREATE TABLE lake.spent AS SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent FROM lake.orders GROUP BY o_custkey")
    return engine.sql("SELECT * FROM lake.spent")


@query("view_over_table", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus")
def view_over_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, _ = _managed(spark, sf_dir, "orders")
    engine.sql("CREATE VIEW lake.dear AS SELECT * FROM lake.orders WHERE o_totalprice > 100000")
    engine.sql("CREATE VIEW lake.counted AS SELECT d.o_orderstatus, count(*) AS n FROM lake.dear d GROUP BY d.o_orderstatus")
    return engine.sql("SELECT * FROM lake.counted")


def _through(kind: str, select: str, schema: str | None, **options: str):
    """Nations written in a format and read again."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{fresh_engine(spark).catalog.root.uri}/{kind}"
        write(table(spark, sf_dir, "nation").selectExpr(*select.split("; ")), kind, path, **options)
        return read(spark, kind, path, schema, **options)

    return run


_NATION = "n_nationkey INT, n_name STRING, n_regionkey INT"
for _kind, _options in (("csv", {"header": "true"}), ("json", {}), ("orc", {}), ("parquet", {"compression": "zstd"})):
    query(f"scan_{_kind}_files", "SELECT n_nationkey, n_name, n_regionkey FROM nation")(_through(_kind, "n_nationkey; n_name; n_regionkey", _NATION, **_options))
query("scan_text_files", "SELECT n_name AS value FROM nation")(_through("text", "n_name", None))


@query("scan_binary_files", "SELECT CAST(sum(length(n_name) + 1) AS BIGINT) AS bytes, count(*) AS lines FROM nation")
def scan_binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{fresh_engine(spark).catalog.root.uri}/raw"
    write(table(spark, sf_dir, "nation").select("n_name").repartition(3), "text", path)
    files = read(spark, "binaryFile", path, pathGlobFilter="part-*")
    lines = F.size(F.split(F.decode("content", "UTF-8"), "\n")) - 1
    return files.agg(F.sum("length").alias("bytes"), F.sum(lines).cast("long").alias("lines"))


@query("time_travel", "SELECT 'now' AS at, count(*) AS n FROM region WHERE r_regionkey > 2 UNION ALL SELECT 'before', count(*) FROM region")
def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, _ = _managed(spark, sf_dir, "region")
    engine.sql("DELETE FROM lake.region WHERE r_regionkey <= 2")
    return engine.sql("SELECT 'now' AS at, count(*) AS n FROM lake.region UNION ALL SELECT 'before', count(*) FROM lake.region VERSION AS OF 1")


@query("evolve_scenario", "SELECT event_id, NULL::VARCHAR AS source FROM events UNION ALL SELECT event_id + 1000000, 'late' FROM events WHERE event_type = 'error'")
def evolve_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create, append, add a column, append rows that carry it, read: old rows have null."""
    _, events = _managed(spark, sf_dir, "events")
    events.evolve({"source": T.StringType()})
    late = table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("event_id", F.col("event_id") + 1000000).withColumn("source", F.lit("late"))
    return events.append(late).scan(["event_id", "source"])


@query("namespaces", "SELECT 'lake' AS namespace, 'a' AS \"table\" UNION ALL SELECT 'lake', 'b'")
def namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = fresh_engine(spark)
    engine.catalog.create_namespace(("lake", "inner"))
    for t in ("lake.b", "lake.a", "lake.inner.c"):
        engine.sql(f"CREATE TABLE {t} (x INT)")
    return engine.sql("SHOW TABLES IN lake")


@query("stream_to_table", "SELECT event_id, event_type FROM events")
def stream_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file stream into a managed table, exactly once."""
    engine, events = _managed(spark, sf_dir, "events", where="false")
    feed = f"{engine.catalog.root.uri}/feed"
    table(spark, sf_dir, "events").repartition(3).write.parquet(feed)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(feed)
    write_table(stream, events, f"{engine.catalog.root.uri}/checkpoint").awaitTermination()
    return events.refresh().scan(["event_id", "event_type"])


@query("stream_two_to_table", "SELECT event_id, event_type FROM events UNION ALL SELECT event_id + 1000000, 'again' FROM events")
def stream_two_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams into one table, and one of them again with a checkpoint of its own: nothing is lost."""
    engine, events = _managed(spark, sf_dir, "events", where="false")
    root = engine.catalog.root.uri
    table(spark, sf_dir, "events").where("event_id % 2 = 0").repartition(3).write.parquet(f"{root}/even")
    table(spark, sf_dir, "events").where("event_id % 2 <> 0").repartition(3).write.parquet(f"{root}/odd")
    even, odd = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/{x}") for x in ("even", "odd"))
    again = [s.withColumn("event_id", F.col("event_id") + 1000000).withColumn("event_type", F.lit("again")) for s in (even, odd)]
    streams = [write_table(s, engine.catalog.load_table("lake.events"), f"{root}/checkpoint-{k}") for k, s in enumerate([even, odd, *again])]
    for s in streams:
        s.awaitTermination()
    write_table(even, events, f"{root}/checkpoint-0").awaitTermination()  # has nothing more to do
    return events.refresh().scan(["event_id", "event_type"])
