"""User functions: SQL scalar and table functions, and vectorised Python ones for what SQL can't say."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def register_sql_functions(spark: SparkSession) -> None:
    """Functions that the optimizer inlines."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION net_price(price DOUBLE, discount DOUBLE) RETURNS DOUBLE RETURN price * (1 - discount)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION day_span(first DATE, days INT) RETURNS TABLE(day DATE) RETURN SELECT explode(sequence(first, date_add(first, days - 1)))")


@F.pandas_udf(T.DoubleType())
def clipped(values, low, high):
    """Values held within bounds, a batch at a time."""
    return values.clip(lower=low, upper=high)


@F.pandas_udf(T.DoubleType())
def geometric_mean(values: pd.Series) -> float:
    """An aggregate: the geometric mean of what isn't null; null for no values.  A group's values meet in one task."""
    values = values.dropna()
    return float(np.exp(np.log(values).mean())) if len(values) else None


@F.udtf(returnType=T.StructType([T.StructField("word", T.StringType()), T.StructField("place", T.IntegerType())]))
class Words:
    """A table function: the words of a text and their places, from 1; none for null."""

    def eval(self, text: str | None) -> Iterator[tuple[str, int]]:
        for place, word in enumerate((text or "").split(), 1):
            yield word, place
