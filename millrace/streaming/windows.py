"""Event-time operators on Structured Streaming; each works on a batch frame as well."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def zoned(df: DataFrame, time: str) -> DataFrame:
    """Watermarks reject times without a zone: they are read as UTC."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(df: DataFrame, time: str, size: str, keys: tuple[str, ...], late: str | None = None, slide: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates over fixed (or sliding) windows; ``late`` sets the watermark."""
    df = zoned(df, time)
    df = df.withWatermark(time, late) if late else df
    span = F.window(time, size, slide) if slide else F.window(time, size)
    found = df.groupBy(span.alias("w"), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("opened"), *keys, *aggregates)


def session(df: DataFrame, time: str, gap: str, keys: tuple[str, ...], late: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates over sessions that a gap ends."""
    df = zoned(df, time)
    df = df.withWatermark(time, late) if late else df
    found = df.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("opened"), F.col("w.end").cast("timestamp_ntz").alias("closed"), *keys, *aggregates)


def deduplicated(df: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """First rows by key, forgetting keys once the watermark has passed them."""
    return zoned(df, time).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, late: str) -> DataFrame:
    """Rows of ``right`` up to ``within`` after those of ``left``, by key; both sides' state is bounded by watermarks.

    The key stands once in the result; no other column may be on both sides.
    """
    a = zoned(left, left_time).withWatermark(left_time, late).alias("a")
    b = zoned(right, right_time).withWatermark(right_time, late).alias("b")
    first, second = F.col(f"a.`{left_time}`"), F.col(f"b.`{right_time}`")
    condition = (F.col(f"a.`{key}`") == F.col(f"b.`{key}`")) & (second >= first) & (second <= first + F.expr(f"INTERVAL {within}"))
    return a.join(b, condition).drop(F.col(f"b.`{key}`"))


def running_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, n, total)``: how many rows and what sum each key has so far, kept as state between batches.

    In update mode every batch gives the keys that it changed.  Null keys are a key, null values add nothing.
    """
    kind = df.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType())])
    kept = T.StructType([T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType())])

    def add(of: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for part in parts:
            n, total = n + len(part), total + float(part[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [of[0]], "n": [n], "total": [total]})

    return df.select(key, F.col(value).cast("double")).groupBy(key).applyInPandasWithState(add, out, kept, "update", GroupStateTimeout.NoTimeout)
