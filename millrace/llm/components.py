"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Shared


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return tuple(row)


def components(links: DataFrame, shared: Shared, tag: str = "stars") -> DataFrame:
    """``links(u, v)`` of longs -> ``(node, root)``, root the smallest node that can be reached.

    Nodes without links to others are absent.  Every round writes its links to the shared folder;
    the number of rounds grows as the logarithm of the longest chain.  Loops and repeats are
    harmless; an empty table gives an empty table.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    edges = shared.table(edges, f"{tag}-0")
    before, k = _digest(edges), 0
    while before[0]:
        k += 1
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select("b", "a"))
        # Written, so that the join's two sides are plain shuffles, of which a hub's links can be split.
        least = shared.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{tag}-least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = shared.table(large, f"{tag}-large")
        least = shared.table(large.groupBy("a").agg(F.min("b").alias("m")), f"{tag}-small")
        pairs = F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        small = large.join(least, "a").select(pairs.alias("p")).select("p.a", "p.b").where("a <> b").distinct()
        edges = shared.table(small, f"{tag}-{k}")
        after = _digest(edges)
        if k > 1:
            shared.remove(f"{tag}-{k - 2}")
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
