"""Row patterns: MATCH_RECOGNIZE as a DataFrame operator."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPANS = T.ArrayType(T.StructType([T.StructField("match", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))


def match_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], define: dict[str, Column], pattern: str, keep: Sequence[str] = ()) -> DataFrame:
    """Runs of rows that fit a pattern: ``by, match, n`` and ``<c>_first, <c>_last`` for each column of ``order`` and ``keep``.

    ``define`` names each kind of row by one letter; a row is of the first kind whose condition
    holds, and of none otherwise (conditions may hold window expressions).  ``pattern`` is a regular
    expression over the letters; matches are leftmost, don't overlap, and are numbered from 1 in each
    partition.  The rows of a partition are ordered by ``order``, which is to leave no ties; null keys
    are a partition.  Conditions stay in the JVM; Python sees one letter a row.  A partition's letters and
    the columns that are kept meet in one task.
    """
    if bad := [k for k in define if not re.fullmatch("[A-Za-z]", k)]:
        raise ValueError(f"a kind is named by one letter, not {bad}")
    compiled = re.compile(pattern)
    kind = F.lit("-")
    for letter, holds in reversed(define.items()):
        kind = F.when(holds, F.lit(letter)).otherwise(kind)
    wanted = [*order, *(c for c in keep if c not in order)]

    @F.pandas_udf(_SPANS)
    def spans(letters: pd.Series) -> pd.Series:
        found = ([m for m in compiled.finditer(text) if m.end() > m.start()] for text in letters)
        return pd.Series([[{"match": k, "first": m.start(), "last": m.end() - 1} for k, m in enumerate(x, 1)] for x in found], dtype=object)

    rows = df.select(*by, F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(wanted)]).alias("row"), kind.alias("kind"))
    runs = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("row", "kind"))).alias("rows"))
    runs = runs.withColumn("span", F.explode(spans(F.array_join(F.col("rows.kind"), ""))))
    first, last = (F.element_at("rows", F.col(f"span.{x}") + 1)["row"] for x in ("first", "last"))
    ends = [x.alias(f"{c}_{name}") for k, c in enumerate(wanted) for name, x in (("first", first[f"c{k}"]), ("last", last[f"c{k}"]))]
    return runs.select(*by, F.col("span.match").alias("match"), (F.col("span.last") - F.col("span.first") + 1).alias("n"), *ends)
