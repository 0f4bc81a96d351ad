"""Window forms that Spark's parser lacks: GROUPS frames, QUALIFY, DISTINCT ON, gap sessions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def groups_frame(df: DataFrame, partition: Sequence[str], order: Sequence[Column | str], start: int, end: int, **aggregates: Column) -> DataFrame:
    """``agg OVER (... GROUPS BETWEEN start AND end)``: peers are numbered, then framed by RANGE over the numbers."""
    peer = "__peer"
    while peer in df.columns:
        peer += "_"
    df = df.withColumn(peer, F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    frame = Window.partitionBy(*partition).orderBy(peer).rangeBetween(start, end)
    return df.withColumns({name: a.over(frame) for name, a in aggregates.items()}).drop(peer)


def groups_sums(df: DataFrame, partition: Sequence[str], order: Sequence[str], start: int, end: int, **sums: Column) -> DataFrame:
    """``groups_frame`` for sums, where a few partitions hold many rows of few peers: one row a group of peers goes through the window."""
    keys = [*partition, *order]
    frame = Window.partitionBy(*partition).orderBy(*order).rowsBetween(start, end)
    peers = df.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return join_peers(df, peers.select(*keys, *[F.sum(n).over(frame).alias(n) for n in sums]), keys)


CHUNK, CHUNKS, EACH, BINS = 250_000, 1_000, 40, 8


def chunk_of(df: DataFrame, order: Sequence[str], rows: int = CHUNK) -> Column:
    """The number of the stretch of about ``rows`` rows that a row lies in, by ascending ``order``, nulls first.

    Bounds between stretches come from a sample; they are constants, so that every scan deals the rows
    alike, and wherever they lie no row is lost: only how even the stretches are depends on them.  More than
    ``CHUNKS`` stretches aren't made, they get longer instead.
    """
    total = df.count()
    n = min(-(-total // rows), CHUNKS)
    if n < 2:
        return F.lit(0)
    fields = [(f"f{i}", df.schema[c].dataType) for i, c in enumerate(order)]
    key = F.struct(*[F.col(c).alias(f) for c, (f, _) in zip(order, fields, strict=True)])
    drawn = df.select(key.alias("key")).sample(min(1.0, EACH * n / total), seed=1).agg(F.sort_array(F.collect_list("key"))).first()[0]
    if not drawn:
        return F.lit(0)
    if isinstance(df.schema[order[0]].dataType, T.NumericType) and (even := _even_bins(F.col(order[0]).cast("double"), [r.f0 for r in drawn], n)) is not None:
        return even
    cuts = [drawn[len(drawn) * i // n] for i in range(1, n)]
    bounds = F.array(*[F.struct(*[F.lit(cut[f]).cast(kind).alias(f) for f, kind in fields]) for cut in cuts])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(bounds, at + step - 1) <= key), at + step).otherwise(at))


def _even_bins(x: Column, drawn: list, n: int) -> Column | None:
    """Stretches as runs of bins of one width, which costs far less than a search for bounds; None if a bin is longer than two stretches."""
    known = [float(v) for v in drawn if v is not None and math.isfinite(v)]
    low, high, bins = min(known, default=0.0), max(known, default=0.0), BINS * n
    if not low < high or not math.isfinite(scale := bins / (high - low)):
        return None
    held = [0] * bins
    for v in drawn:
        held[0 if v is None or v <= low else bins - 1 if not v < high else min(int((float(v) - low) * scale), bins - 1)] += 1
    if max(held) * n > 2 * len(drawn):
        return None
    upto, numbers = 0, []
    for count in held:
        numbers.append(upto * n // len(drawn))
        upto += count
    place = F.when(x.isNull() | (x <= low), 0).when(x >= high, bins - 1).otherwise(F.least(F.floor((x - low) * scale), F.lit(bins - 1)))
    return F.get(F.array(*[F.lit(k) for k in numbers]), place.cast("int"))


def _stretches(rows: DataFrame, partition: Sequence[str], chunk: str, sums: dict[str, Column]) -> DataFrame:
    """What each stretch of each partition holds (``name``), all before it (``name_before``) and the whole partition (``name_total``): one row a stretch."""
    whole = Window.partitionBy(*partition)
    before = whole.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.groupBy(*partition, chunk).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    more = {f"{n}_before": F.coalesce(F.sum(n).over(before), F.lit(0)) for n in sums} | {f"{n}_total": F.sum(n).over(whole) for n in sums}
    return found.withColumns(more)


def _same(names: Sequence[str], renamed: Sequence[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(names, renamed, strict=True):
        out &= F.col(a).eqNullSafe(F.col(b))
    return out


def running(df: DataFrame, partition: Sequence[str], order: Sequence[str], rows: int = CHUNK, **sums: Column) -> DataFrame:
    """``sum(...) OVER (PARTITION BY ... ORDER BY ... ROWS UNBOUNDED PRECEDING)`` for few partitions that no task can hold, whole numbers only.

    Adds each sum and ``name_total``, that of the partition.  The rows are dealt by stretches of the order,
    a window runs in each, and one broadcast row a stretch says what lies before it.
    """
    chunk, key = "__chunk", [f"__key{i}" for i in range(len(partition))]
    dealt = df.withColumn(chunk, chunk_of(df, order, rows))
    parts = _stretches(dealt, partition, chunk, {f"__{n}": c for n, c in sums.items()})
    parts = parts.select(*[F.col(p).alias(k) for p, k in zip(partition, key, strict=True)], F.col(chunk).alias("__part"), *[f"__{n}_{x}" for n in sums for x in ("before", "total")])
    inside = Window.partitionBy(*partition, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = dealt.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    found = found.join(F.broadcast(parts), _same([*partition, chunk], [*key, "__part"]))
    return found.select(*[f"`{c}`" for c in df.columns], *[(F.col(n) + F.col(f"__{n}_before")).alias(n) for n in sums], *[F.col(f"__{n}_total").alias(f"{n}_total") for n in sums])


def join_peers(df: DataFrame, peers: DataFrame, keys: Sequence[str], limit: int = 100_000) -> DataFrame:
    """Gives every row what its peers, the rows of equal ``keys``, have in common; ``peers`` is broadcast if it has few rows."""
    key = [f"__peer{i}" for i in range(len(keys))]
    few = peers.limit(limit + 1).count() <= limit
    peers = peers.withColumnsRenamed(dict(zip(keys, key, strict=True)))
    return df.join(F.broadcast(peers) if few else peers, _same(keys, key)).drop(*key)


def percentiles(df: DataFrame, group: Sequence[str], value: str, shares: dict[str, float], rows: int = CHUNK) -> DataFrame:
    """Exact interpolated percentiles of a few large groups, nulls left out: only the stretches that hold them are sorted."""
    chunk, key = "__chunk", [f"__key{i}" for i in range(len(group))]
    narrow = df.select(*group, value)
    dealt = narrow.withColumn(chunk, chunk_of(narrow, [value], rows))
    parts = _stretches(dealt, group, chunk, {"__n": F.when(F.col(value).isNotNull(), 1).otherwise(0)})
    at = {f"__at{i}": share * (F.col("__n_total") - 1) for i, share in enumerate(shares.values())}
    ends = [f(x) for x in at.values() for f in (F.floor, F.ceil)]
    holds = F.lit(False)
    for end in ends:
        holds |= (end >= F.col("__n_before")) & (end < F.col("__n_before") + F.col("__n"))
    wanted = parts.where(holds).select(*[F.col(g).alias(k) for g, k in zip(group, key, strict=True)], F.col(chunk).alias("__part"), "__n_before", "__n_total")
    found = dealt.where(F.col(value).isNotNull()).join(F.broadcast(wanted), _same([*group, chunk], [*key, "__part"]))
    place = F.row_number().over(Window.partitionBy(*group, chunk).orderBy(value)) - 1 + F.col("__n_before")
    near = found.withColumn("__place", place)
    out = []
    for name, x in zip(shares, at.values(), strict=True):
        low, high = (F.max(F.when(F.col("__place") == f(x), F.col(value))) for f in (F.floor, F.ceil))
        out.append((low + (high - low) * F.max(x - F.floor(x))).alias(name))
    return narrow.select(*group).distinct().join(near.groupBy(*[F.col(g).alias(k) for g, k in zip(group, key, strict=True)]).agg(*out), _same(group, key), "left").drop(*key)


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """Filters by a window expression, which SQL's WHERE can't hold."""
    name = "__qualifies"
    while name in df.columns:
        name += "_"
    return df.withColumn(name, condition).where(name).drop(name)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark drops the others before the shuffle (WindowGroupLimit)."""
    return qualify(df, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) <= k)


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in the order."""
    return top_per_group(df, keys, order, 1)


def sessions(df: DataFrame, keys: Sequence[str], time: str, gap: str) -> DataFrame:
    """Numbers runs of rows whose gaps are at most an interval: adds ``session`` (from 1 in each key)."""
    order = Window.partitionBy(*keys).orderBy(time)
    far = F.coalesce(F.col(time) > F.lag(time).over(order) + F.expr(f"INTERVAL {gap}"), F.lit(True))
    return df.withColumn("session", F.sum(far.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
