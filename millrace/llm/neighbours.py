"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut into halves and each half is quantised by its own k centroids, so k + k
centroids make k * k cells.  A query walks the pairs of centroids in the order of their summed
distance, with a heap, until the cells it has met hold enough vectors; those are ranked by their
exact cosine.  How many are enough is measured: for a bounded set of queries the true neighbours
are found by brute force, and the walk is made long enough to meet the wanted share of them.

Equal vectors are one entry with their smallest ids, as many as a result can need, so a vector
that a third of all rows share costs no more than another.  A large cell is cut into chunks; the
vectors of a chunk are held by a task and its queries stream past.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Shared, hashed_sample

#: Parameters.  SAMPLE vectors at most fit the centroids, PROBES queries at most measure the walk.
K, SAMPLE, PROBES, AIM, CHUNK, RECALL, MOST_CENTROIDS = 5, 8192, 128, 1024, 8192, 0.96, 1024
#: Cosines by matrix product and by the fixed order of sums differ by less.
TIE = 1e-9


@dataclass
class Index:
    left: np.ndarray  # [k, d // 2]
    right: np.ndarray  # [k, d - d // 2]
    counts: np.ndarray  # [k * k] entries of each cell
    enough: int = 1

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.left.shape[1]
        return tuple((h * h).sum(1)[:, None] - 2 * h @ c.T + (c * c).sum(1)[None] for h, c in ((x[:, :cut], self.left), (x[:, cut:], self.right)))

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * len(self.right) + b.argmin(axis=1)

    def walk(self, a: np.ndarray, b: np.ndarray) -> Iterator[int]:
        """Non-empty cells by rising distance; a, b: one query's distances to both sets of centroids."""
        i_of, j_of = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        heap = [(float(a[i_of[0]] + b[j_of[0]]), 0, 0)]
        reached = np.zeros(len(a), dtype=np.int64)  # how far each row of pairs has been taken
        k = len(b)
        while heap:
            _, i, j = heapq.heappop(heap)
            reached[i] = j + 1
            cell = int(i_of[i]) * k + int(j_of[j])
            if self.counts[cell]:
                yield cell
            if j + 1 < k and (i == 0 or reached[i - 1] > j + 1):
                heapq.heappush(heap, (float(a[i_of[i]] + b[j_of[j + 1]]), i, j + 1))
            if i + 1 < len(a) and reached[i + 1] == j and (j == 0 or reached[i + 1] > j - 1):
                heapq.heappush(heap, (float(a[i_of[i + 1]] + b[j_of[j]]), i + 1, j))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0][:, None]
    return c


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v array<double>)`` of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False))).where(F.exists("v", lambda x: x != 0))
    widths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("v") == (widths[0].n if widths else 0))


def build(vectors: DataFrame, shared: Shared, k: int) -> tuple[Index | None, DataFrame]:
    """The index, and its entries ``(v, ids, cell)``: distinct vectors with their k + 1 smallest ids.

    The centroids are fitted on SAMPLE vectors at most, of the smallest hashes; every vector is an entry.
    """
    order = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    entries = shared.table(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    n = entries.count()
    if not n:
        return None, entries.withColumn("cell", F.lit(0))
    sample = hashed_sample(entries, "v", SAMPLE).select("v").toArrow()
    x = unit(matrix(sample.column(0).combine_chunks()))
    size = int(min(max(2, np.ceil(np.sqrt(n / AIM))), MOST_CENTROIDS, len(x)))
    cut = x.shape[1] // 2
    index = Index(k_means(x[:, :cut], size) if cut else np.zeros((1, 0)), k_means(x[:, cut:], size), np.zeros(0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cells = index.cells(unit(matrix(b.column(0))))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells, pa.int32())], names=["v", "ids", "cell"])

    entries = shared.table(entries.mapInArrow(assign, "v array<double>, ids array<long>, cell int"), "entries")
    index.counts = np.zeros(len(index.left) * len(index.right), dtype=np.int64)
    for r in entries.groupBy("cell").count().collect():  # at most MOST_CENTROIDS squared
        index.counts[r.cell] = r["count"]
    return index, entries


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (unit(q) @ unit(x).T)


def measure(index: Index, entries: DataFrame, queries: DataFrame, k: int, recall: float) -> int:
    """Vectors that a walk must meet for the share ``recall`` of true neighbours, over PROBES queries."""
    few = hashed_sample(queries, "query_id", PROBES).toArrow()
    q = matrix(few.column(1).combine_chunks())
    if not len(q):
        return 1

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            s = cosines(q, matrix(b.column(0)))
            top = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
            cell = b.column(2).to_numpy()
            held.append(np.stack([np.repeat(np.arange(len(q)), top.shape[1]), np.take_along_axis(s, top, 1).ravel(), cell[top].ravel()], axis=1))
        if held:
            rows = np.concatenate(held)
            rows = rows[np.lexsort((-rows[:, 1], rows[:, 0]))]
            first = np.searchsorted(rows[:, 0], rows[:, 0])
            rows = rows[np.arange(len(rows)) - first <= k]
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].astype(np.int32)), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32))], names=["q", "s", "cell"])

    found = entries.mapInArrow(best, "q int, s double, cell int")
    order = Window.partitionBy("q").orderBy(F.desc("s"))
    found = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1).collect()
    wanted: dict[int, list[int]] = {}
    for r in sorted(found, key=lambda r: (r.q, r.at)):
        wanted.setdefault(r.q, []).append(r.cell)
    a, b = index.distances(unit(q))
    need = []
    for i, cells in wanted.items():
        met, total = {}, 0
        for cell in index.walk(a[i], b[i]):
            total += int(index.counts[cell])
            met[cell] = total
        need += [met[c] for c in cells[1:] or cells]  # the first is the query itself
    return int(np.quantile(need, recall, method="higher")) if need else 1


def search(vectors: DataFrame, every: int, k: int = K, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found for each row whose id is divisible by ``every``.

    Nearness is the cosine in double precision, ties go to the smaller id, a row's own id is no
    candidate.  Rows take no part if the id is null, or the vector is null, empty, zero, holds a
    null or a non-finite component, or has another length than most.  A repeated row (same id and
    vector) counts once.  If there are fewer candidates than k, all are returned; an empty table
    gives an empty table.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    shared = Shared.create(spark, "neighbours")
    rows = valid(vectors, id_col, vector_col)
    index, entries = build(rows, shared, k)
    out = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return spark.createDataFrame([], out)
    queries = shared.table(rows.where(F.col("vec_id") % every == 0).distinct().select(F.col("vec_id").alias("query_id"), "v"), "queries")
    index.enough = max(k + 1, measure(index, entries, queries, k, recall))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            a, c = index.distances(unit(matrix(b.column(1))))
            row, cells, chunks = [], [], []
            for i in range(b.num_rows):
                total = 0
                for cell in index.walk(a[i], c[i]):
                    parts = -(-int(index.counts[cell]) // CHUNK)
                    row += [i] * parts
                    cells += [cell] * parts
                    chunks += range(parts)
                    total += int(index.counts[cell])
                    if total >= index.enough:
                        break
                if len(row) >= 4096 or i == b.num_rows - 1:
                    take = pa.array(row, pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(chunks, pa.int32()), pa.array([1] * len(row), pa.int32()), b.column(0).take(take), b.column(1).take(take), pa.nulls(len(row), pa.list_(pa.int64()))], names=["cell", "chunk", "side", "query_id", "v", "ids"])
                    row, cells, chunks = [], [], []

    layout = "cell int, chunk int, side int, query_id long, v array<double>, ids array<long>"
    parts = entries.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts")).where("parts > 1")
    held = entries.join(parts, "cell", "left").withColumn("chunk", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).cast("int"))
    held = held.select("cell", "chunk", F.lit(0).alias("side"), F.lit(None).cast("long").alias("query_id"), "v", "ids")
    met = held.unionAll(queries.mapInArrow(probe, layout))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, x, ids, nx = None, [], [], None
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q, v, s = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((v, -s, q))
            q, v, s = q[order], v[order], s[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            return q[keep], v[keep], s[keep]

        def score(qid: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            close = cosines(q, nx)  # own vector may be among the first k + 1; ties with the last of them all stay
            top = min(k + 1, len(nx))
            least = np.partition(close, len(nx) - top, axis=1)[:, len(nx) - top]
            of, pick = np.nonzero(close >= least[:, None] - TIE)
            s = np.empty(len(of))
            for at in range(0, len(of), 1 << 14):  # the measure itself, in a fixed order of sums
                a, b = q[of[at : at + (1 << 14)]], nx[pick[at : at + (1 << 14)]]
                s[at : at + (1 << 14)] = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
            lengths = np.array([len(ids[p]) for p in pick])
            rows = np.repeat(np.arange(len(pick)), lengths)
            v = np.concatenate([ids[p] for p in pick])
            other = v != qid[of[rows]]
            return qid[of[rows]][other], v[other], s[rows][other]

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
            for a, z in zip([0, *change], [*change, b.num_rows]):
                if (now := (cols[0][a], cols[1][a])) != key:
                    key, x, ids, nx = now, [], [], None
                part = matrix(b.column(4).slice(a, z - a))
                if cols[2][a] == 0:
                    x.append(part)
                    ids += [np.array(i) for i in b.column(5).slice(a, z - a).to_pylist()]
                elif x:
                    nx = np.concatenate(x) if nx is None else nx
                    qid = b.column(3).slice(a, z - a).to_numpy(zero_copy_only=False).astype(np.int64)
                    for at in range(0, len(qid), 256):
                        found.append(score(qid[at : at + 256], part[at : at + 256]))
                        size += len(found[-1][0])
                    if size > 400_000:
                        found = [best()]
                        size = len(found[0][0])
                        if size > 200_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found[0]], names=["query_id", "vec_id", "score"])
                            found, size = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best()], names=["query_id", "vec_id", "score"])

    met = met.repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "side")
    found = met.mapInArrow(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
