"""Event-time windows over ``events``: batch twins with an oracle, and the stream itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.windows import sessions
from millrace.plans.catalogue import query
from millrace.plans.engine import Engine
from millrace.plans.lakehouse import fresh_engine
from millrace.sources.tables import table
from millrace.streaming import windows
from millrace.streaming.sink import upsert_table, write_table


@query("window_tumbling", "SELECT date_trunc('hour', ts) AS opened, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ("event_type",), n=F.count("*"), total=F.sum("value"))
    return found.withColumn("total", F.round("total", 2))


@query(
    "window_sliding",
    """SELECT opened, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS opened FROM events) GROUP BY opened""",
)
def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(table(spark, sf_dir, "events"), "ts", "2 hours", (), slide="1 hour", n=F.count("*"))


_SESSIONS = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS far FROM events),
     s AS (SELECT user_id, ts, sum(far) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS opened, max(ts) + INTERVAL 6 HOUR AS closed, count(*) AS n FROM s GROUP BY user_id, s
"""


@query("window_session", _SESSIONS)
def window_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.session(table(spark, sf_dir, "events"), "ts", "6 hours", ("user_id",), n=F.count("*"))


@query(
    "session_numbers",
    """SELECT event_id, CAST(sum(far) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM
       (SELECT event_id, user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS far FROM events)""",
)
def session_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", "6 HOURS").select("event_id", "session")


def _fed(spark: SparkSession, sf_dir: str, name: str) -> tuple[Engine, DataFrame]:
    """A fresh warehouse, and a table of the tests as a stream of some files."""
    engine = fresh_engine(spark)
    engine.catalog.create_namespace("lake")
    feed = f"{engine.catalog.root.uri}/feed"
    rows = table(spark, sf_dir, name)
    rows.repartition(4).write.parquet(feed)
    return engine, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(feed)


def _landed(engine: Engine, stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The stream run into a managed table until it has caught up: appended, or the last row of each key."""
    made = engine.catalog.create_table("lake.found", T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema]))
    checkpoint = f"{engine.catalog.root.uri}/checkpoint"
    (upsert_table(stream, made, keys, checkpoint) if keys else write_table(stream, made, checkpoint)).awaitTermination()
    return made.refresh().scan()


@query("stream_tumbling", "SELECT date_trunc('day', ts) AS opened, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A watermarked aggregate in update mode, upserted into a managed table."""
    engine, events = _fed(spark, sf_dir, "events")
    found = windows.tumbling(events, "ts", "1 day", ("event_type",), late="60 days", n=F.count("*"))
    return _landed(engine, found, ["opened", "event_type"])


@query("stream_deduplicated", "SELECT DISTINCT user_id, event_type FROM events")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, events = _fed(spark, sf_dir, "events")
    return _landed(engine, windows.deduplicated(events, "ts", ["user_id", "event_type"], "60 days").select("user_id", "event_type"))


@query(
    "stream_interval_join",
    """SELECT a.user_id, a.event_id AS seen_id, b.event_id AS bought_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR
       WHERE a.event_type = 'view' AND b.event_type = 'purchase'""",
)
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases within twelve hours after a view, stream to stream."""
    engine, events = _fed(spark, sf_dir, "events")
    seen = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("seen_id"), F.col("ts").alias("seen_at"))
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("bought_id"), F.col("ts").alias("bought_at"))
    found = windows.interval_join(seen, bought, "user_id", "seen_at", "bought_at", "12 hours", "60 days")
    return _landed(engine, found.select("user_id", "seen_id", "bought_id"))


@query("stream_stateful", "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def stream_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, events = _fed(spark, sf_dir, "events")
    return _landed(engine, windows.running_totals(events, "user_id", "value"), ["user_id"]).withColumn("total", F.round("total", 2))
