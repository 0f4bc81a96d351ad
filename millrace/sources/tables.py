"""Sources and sinks that Spark reads and writes itself."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
FORMATS = ("parquet", "orc", "csv", "json", "text", "binaryFile")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs SQL over the tables of a directory; only the ones that the text names are opened."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def read(spark: SparkSession, kind: str, path: str, schema: str | None = None, **options) -> DataFrame:
    """A file source; text-like formats want a schema, as inferring one reads the data twice."""
    if kind not in FORMATS:
        raise ValueError(f"format {kind!r}; known: {', '.join(FORMATS)}")
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, kind: str, path: str, mode: str = "error", partition_by: tuple[str, ...] = (), **options) -> None:
    if kind not in FORMATS or kind == "binaryFile":
        raise ValueError(f"can't write {kind!r}")
    df.write.format(kind).mode(mode).options(**options).partitionBy(*partition_by).save(path)
