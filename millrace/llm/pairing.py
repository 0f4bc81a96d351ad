"""Links inside groups of rows of any size: no task holds a large group, and no pairs are listed.

A small group is one task.  Within a task a few rows ask first; what they join into one tree needn't
be compared with itself again, so only the rows outside of it ask the others.

A group above the block goes in parts.  Some of its rows, its *hubs*, drawn by a hash, go to every
part: rows that match a hub of the largest set of linked hubs are joined through it and are
*covered*.  Only the rows that aren't covered, if there are any, are then compared with all parts.
Two covered rows are in one component already, so no link is lost, and a group of copies costs its
size, not its square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Shared, record_batch

#: Rows that ask first, in a task and in a large group.
HUBS = 32
Match = Callable[[np.ndarray], Iterator[tuple[int, np.ndarray]]]


class Forest:
    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        found = self.parent[at]
        while not np.array_equal(up := self.parent[found], found):
            found = up
        return found

    def unite(self, at: np.ndarray) -> None:
        roots = self.roots(at)
        self.parent[roots] = self.parent[at] = roots.min()

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows that aren't their tree's root, and the roots."""
        roots = self.roots(np.arange(len(self.parent)))
        child = np.flatnonzero(roots != np.arange(len(roots)))
        return child, roots[child]


def join_all(n: int, find: Match, hubs: int = HUBS) -> Forest:
    """The components of ``n`` rows under ``find``."""
    out, asks = Forest(n), np.arange(n)
    if n > 4 * hubs:
        for i, near in find(asks[:: n // hubs]):
            out.unite(np.append(near, i))
        roots = out.roots(asks)
        names, sizes = np.unique(roots, return_counts=True)
        asks = asks[roots != names[sizes.argmax()]]
    for i, near in find(asks):
        out.unite(np.append(near, i))
    return out


def _first_round(nodes: np.ndarray, asks: np.ndarray, find: Match) -> tuple[Forest, np.ndarray]:
    """Links to the hubs (the rows that ask), and the other rows that the largest set of hubs leaves uncovered."""
    hubs = np.flatnonzero(asks)
    hubs = hubs[np.argsort(nodes[hubs], kind="stable")]  # the same in all parts
    out, among, near_of = Forest(len(nodes)), Forest(len(hubs)), []
    place = np.full(len(nodes), -1)
    place[hubs] = np.arange(len(hubs))
    for k, hub in enumerate(hubs):
        near = np.concatenate([[hub], *(x for _, x in find(hubs[k : k + 1]))])
        out.unite(near)
        among.unite(place[near[asks[near]]])
        near_of.append(near)
    covered = np.zeros(len(nodes), dtype=bool)
    if len(hubs):
        roots = among.roots(np.arange(len(hubs)))
        names, sizes = np.unique(roots, return_counts=True)
        for near, root in zip(near_of, roots):
            if root == names[sizes.argmax()]:
                covered[near] = True
    return out, np.flatnonzero(~covered & ~asks)


def link_groups(rows: DataFrame, match: Callable[[pa.Table], Match], shared: Shared, tag: str, block: int, weight: Column, hubs: int = HUBS) -> DataFrame:
    """``rows(g, node, ...)`` -> ``(u, v)``: links that join what ``match`` finds among the rows of each group.

    ``match`` gets the rows of a task, whose columns from the fourth on are those after ``node``.
    ``weight`` is what a row counts against ``block``.
    """
    payload = rows.columns[2:]
    sizes = rows.groupBy("g").agg(F.sum(weight).alias("w"), F.count("*").alias("c"))
    large = shared.table(sizes.where((F.col("w") > block) & (F.col("c") > 2)).select("g", F.ceil(F.col("w") / block).cast("int").alias("parts"), "c"), f"{tag}-large")
    schema = pa.schema([("g", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])

    def solve(j: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = pa.Table.from_batches(held)
        if len(task) < 2 and j != -1:
            return
        nodes, asks = task.column(4).to_numpy(), task.column(3).to_numpy(zero_copy_only=False).astype(bool)
        find, rest = match(task.select(range(5, task.num_columns))), None
        if j == -1:
            out, rest = _first_round(nodes, asks, find)
        elif asks.all():
            out = join_all(len(nodes), find)
        else:
            out = Forest(len(nodes))
            for i, near in find(np.flatnonzero(asks)):
                out.unite(np.append(near, i))
        u, v = (nodes[x] for x in out.links())
        u, v = u[u != v], v[u != v]
        g = task.column(0)[0].as_py()
        if len(u):
            yield record_batch(schema, np.full(len(u), g), u, v)
        if rest is not None and len(rest):
            yield record_batch(schema, np.full(len(rest), g), nodes[rest], pa.nulls(len(rest), pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(k).to_numpy() for k in range(3)]
            new = np.ones(b.num_rows, dtype=bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            cuts = np.flatnonzero(new)
            for a, z in zip(cuts, [*cuts[1:], b.num_rows]):
                key = tuple(k[a] for k in keys)
                if key != last:
                    if held:
                        yield from solve(int(last[2]), held)
                    last, held = key, []
                held.append(b.slice(a, z - a))
        if held:
            yield from solve(int(last[2]), held)

    def solved(tasks: DataFrame) -> DataFrame:
        by = ["g", "i", "j"]
        return tasks.select(*by, "asks", "node", *payload).repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "g long, u long, v long")

    none, some = F.lit(-1), F.lit(True)
    if not large.limit(1).count():
        return solved(rows.withColumns({"i": none, "j": F.lit(0), "asks": some})).select("u", "v")
    dealt = rows.join(large, "g", "left")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    few = dealt.where("parts IS NULL").withColumns({"i": none, "j": F.lit(0), "asks": some})
    many = dealt.where("parts IS NOT NULL")
    drawn = F.shiftrightunsigned(F.xxhash64("node", F.lit(tag)), 11) * 2.0**-53 < F.lit(float(hubs)) / F.col("c")
    parts = many.withColumns({"i": own, "j": none, "asks": ~some})
    asking = many.where(drawn).withColumn("i", every).withColumns({"j": none, "asks": some})
    first = shared.table(solved(few.unionByName(parts).unionByName(asking)), f"{tag}-first")
    found = first.where("v IS NOT NULL").select("u", "v")
    rest = first.where("v IS NULL").select("g", F.col("u").alias("node")).distinct()
    if not rest.limit(1).count():
        return found
    rest = shared.table(many.join(rest, ["g", "node"], "left_semi"), f"{tag}-rest")
    strips = rest.groupBy("g").agg(F.ceil(F.sum(weight) / block).cast("int").alias("strips"))
    mine = F.pmod(F.xxhash64("node", F.lit(1)), F.col("strips")).cast("int")
    asking = rest.join(strips, "g").withColumns({"i": mine, "asks": some}).withColumn("j", every)
    others = many.join(strips, "g").withColumns({"j": own, "asks": ~some}).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))
    return found.unionByName(solved(asking.unionByName(others.select(asking.columns))).select("u", "v"))
