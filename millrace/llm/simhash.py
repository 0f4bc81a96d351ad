"""SimHash near-duplicates: fingerprints compared bit plane by bit plane.

Texts become fingerprints in Python workers (a bit is set if it is set in over half of the hashes of
the text's word shingles).  Fingerprints are dealt into buckets by some of their bits, and compared
inside a bucket as vertical bit planes with carry-save counters (``bitslice``); a bucket of any size
gives back links that join what it holds, never its pairs (``pairing``), and links are joined into
components.

``near_duplicates`` links by the radius alone.  Its buckets lose no link: the 64 bits are cut into
blocks, and two fingerprints that differ in ``r`` bits agree in all but ``r`` of the blocks.

``similar`` links by the similarity of shingle sets, with 128-bit fingerprints.  Two texts that are
alike by four fifths differ in a seventh of their bits, so buckets by bits would have to be ever
more as texts become more: 38 tables for 190 thousand texts, 202 for 15 million, thousands for
billions, if one pair in 500 at the least similarity may be missed.  Its buckets go by the texts'
least rehashed shingles instead, ``ROWS`` of them to a key and ``BANDS`` keys, which texts that
aren't alike hardly ever share, however many there are; a pair at 0.8 misses all keys with a chance of
(1 - 0.8 ** ROWS) ** BANDS, 7 in 100,000.  Inside a bucket bit planes are compared, with a radius
that leaves out 5 in 100,000 of such pairs (3 in 1,000 of texts of five shingles), and the components of what
is near are compared exactly, shingle by shingle, so every link of the result holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.bitslice import matches
from millrace.llm.common import Shared, as_bytes, mix, record_batch, signed, steps, unused
from millrace.llm.components import components
from millrace.llm.pairing import Match, link_groups

#: Parameters of the registered query: words of a shingle, seed, radius; fingerprints compared at once, and aimed at in a bucket.
SHINGLE, SEED, RADIUS, BLOCK, AIM = 3, 42, 3, 8192, 512
#: Parameters of ``similar``: words of a shingle, least similarity as a fraction, words of a fingerprint, radius, keys and their rows, shingles compared at once.
SIMILAR_SHINGLE, LEAST, WIDE, SIMILAR_RADIUS, BANDS, ROWS, SETS = 5, (4, 5), 2, 36, 24, 5, 1 << 19
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# -- fingerprints ---------------------------------------------------------------------------


def shingle_hashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every word shingle, in order; a text of fewer words is one shingle, a wordless one has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    ends, h = ends[min(shingle, len(words)) - 1 :].tolist(), xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, ends)), dtype=np.uint64, count=n)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 if there are none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def shingle_set(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    return np.unique(shingle_hashes(text, SIMILAR_SHINGLE))


def wide_fingerprint(found: np.ndarray) -> list[int]:
    """``WIDE`` words of 64 bits; the later ones from rehashed shingles."""
    return [majority(mix(found, k) if k else found) for k in range(WIDE)]


def band_keys(found: np.ndarray) -> np.ndarray:
    """The bucket keys of a shingle set: each of ``ROWS`` least rehashed shingles, and of its own place."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 1024):
        least = np.minimum(least, (found[None, at : at + 1024] * _FACTORS).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = mix(row, key)
    return key


def set_name(found: np.ndarray) -> int:
    """A hash of a shingle set; 0 for the empty one."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) if len(found) else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row ``(id, fp)`` for each row of ``docs``; null and wordless texts have fingerprint 0."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, shingle, seed) for t in as_bytes(b.column(1))], dtype=np.uint64)
            yield record_batch(schema, b.column(0), pa.array(signed(found)))

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, fp long")


# -- buckets --------------------------------------------------------------------------------


def bucket_masks(n: int, radius: int = RADIUS, aim: int = AIM) -> list[int]:
    """For each bucket table the bits that make its key; no pair within the radius shares none.

    With m blocks and a radius of r, every m - r of the blocks make a table; m is the least for
    which n fingerprints spread to about ``aim`` a bucket.  A key needs no more bits than that.
    """
    need = max(0, ceil(log2(max(1, n / aim))))
    if not need:
        return [0]
    for m in range(radius + 1, 17):
        cuts = [64 * i // m for i in range(m + 1)]
        width = min(cuts[i + 1] - cuts[i] for i in range(m)) * (m - radius)
        if width >= need or m == 16:
            break
    tables = []
    for blocks in combinations(range(m), m - radius):
        left, mask = need, 0
        for i in blocks:
            take = min(cuts[i + 1] - cuts[i], left)
            left -= take
            mask |= ((1 << take) - 1) << cuts[i]
        tables.append(mask)
    return tables


def deal(fps: DataFrame, masks: list[int]) -> DataFrame:
    """``fps(fp)`` -> ``(g, node, fp)``, a row for each bucket; a fingerprint is its own node."""
    keys = [F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long"))) for t, m in enumerate(masks)]
    return fps.select(F.explode(F.array(*keys)).alias("g"), F.col("fp").alias("node"), "fp")


def near_links(dealt: DataFrame, radius: int, shared: Shared, block: int = BLOCK) -> DataFrame:
    """``dealt(g, node, words...)`` -> links ``(u, v)`` that join all that share a bucket within the radius."""

    def match(task: pa.Table) -> Match:
        return matches(np.stack([c.to_numpy() for c in task.columns], axis=1).astype(np.int64).view(np.uint64), radius)

    return link_groups(dealt, match, shared, "near", block, F.lit(1))


# -- linked by the radius -------------------------------------------------------------------


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """One row ``(doc_id, fingerprint, component_id, cluster)`` for each row of ``docs``.

    ``component_id`` is the smallest id that can be reached over links of at most ``radius``
    differing bits.  ``cluster`` names the component by its smallest fingerprint (as a signed
    number); it is there even if no row of the component has an id, where ``component_id`` is null.

    Empty, null and wordless texts have fingerprint 0, linked like any other.  Repeated rows and
    repeated ids give a row each.  An empty table gives an empty table.  Other columns are ignored.
    """
    if not 0 <= radius <= 12:
        raise ValueError("radius must be 0 to 12")
    shared = Shared.create(docs.sparkSession, "simhash")
    prints = shared.table(fingerprints(docs, id_col, text_col, shingle, seed), "prints")
    known = shared.table(prints.groupBy("fp").agg(F.min("id").alias("least")), "known")
    links = near_links(deal(known, bucket_masks(known.count(), radius)), radius, shared, block)
    found = components(links, shared)
    member = known.join(found, known.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    member = member.join(named, "root").select("fp", "root", "component_id")
    return prints.join(member, "fp").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.col("root").alias("cluster"),
    )


# -- linked by the similarity of shingle sets -----------------------------------------------


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))


def set_prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(key, id, node, n, f0, f1, bands)`` for each row: its key, its set's name and size, the wide fingerprint, the bucket keys."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), *((f"f{k}", pa.int64()) for k in range(WIDE)), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(2))
            for i, j in steps(texts):
                sets = list(map(shingle_set, texts[i:j]))
                words = signed(np.array([[set_name(x), *wide_fingerprint(x)] for x in sets], dtype=np.uint64).T)
                bands = [signed(band_keys(x)) if len(x) else np.zeros(0, np.int64) for x in sets]
                yield record_batch(schema, b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), words[0], [len(x) for x in sets], *words[1:], bands)

    rows = docs.select(row_key(id_col, text_col), F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    return rows.mapInArrow(run, "key long, id long, node long, n long, " + ", ".join(f"f{k} long" for k in range(WIDE)) + ", bands array<long>")


def chosen(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, *keep: str) -> DataFrame:
    """The rows of ``docs`` that ``wanted(key, id, times, ...)`` names, one of equal ones, with the columns ``keep`` of it.

    Rows that are repeated (``times``) are spread over many tasks until but one of each is left.
    """
    names = docs.columns
    key, own, salt, turn, *others = unused(names, "key", "id", "salt", "turn", "wanted_key", "wanted_id", "times", *(f"wanted_{c}" for c in keep))
    wanted = wanted.select(*(F.col(c).alias(o) for c, o in zip(("key", "id", "times", *keep), others)))
    rows = docs.withColumns({key: row_key(id_col, text_col), own: F.col(f"`{id_col}`").cast("long")})
    same = (F.col(key) == F.col(others[0])) & F.col(own).eqNullSafe(F.col(others[1]))
    out = [*(F.col(f"`{c}`") for c in names), *(F.col(o).alias(c) for o, c in zip(others[3:], keep))]
    once = rows.join(wanted.where(F.col(others[2]) == 1), same).select(*out)
    many = wanted.where(F.col(others[2]) > 1)
    if not many.limit(1).count():
        return once
    dealt = rows.withColumn(salt, F.spark_partition_id() % 64)
    many = many.withColumn(turn, F.explode(F.sequence(F.lit(0), F.lit(63))))
    met = dealt.join(many, same & (F.col(salt) == F.col(turn))).dropDuplicates([key, own])
    return once.unionByName(met.select(*out))


def like(sets: list[np.ndarray], least: tuple[int, int] = LEAST) -> Match:
    """A function of the sets that ask: yields each with the sets of at least the similarity, by counting common shingles."""
    sizes = np.array([len(x) for x in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]

    def find(asks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for i in asks:
            a, z = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
            count = z - a
            common = np.zeros(len(sets), dtype=np.int64)
            for part in np.array_split(np.arange(len(a)), max(1, int(count.sum()) >> 22)):  # bounded, however common the shingles
                c = count[part]
                at = np.repeat(a[part] - np.cumsum(c) + c, c) + np.arange(c.sum())
                common += np.bincount(owner[at], minlength=len(sets))
            # c / (n + m - c) >= p / q
            near = np.flatnonzero((common > 0) & ((least[0] + least[1]) * common >= least[0] * (len(sets[i]) + sizes)))
            if len(near) > 1:
                yield int(i), near

    return find


def similar_links(docs: DataFrame, id_col: str, text_col: str, units: DataFrame, proposed: DataFrame, shared: Shared, block: int) -> DataFrame:
    """``units(key, id, times, node)`` and ``proposed(node, root)`` -> exact links ``(u, v)``; each set is made once, from one of its rows."""
    least = F.min(F.struct(F.col("id").isNull(), "id", "key", "times")).alias("r")
    wanted = units.join(proposed, "node").groupBy("node", "root").agg(least).select("node", "root", "r.key", "r.id", "r.times")
    texts = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))
    rows = chosen(texts, "i", "t", wanted, "root", "node").select("root", "node", F.col("t").cast("string"))
    schema = pa.schema([("g", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("found", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(2))
            for i, j in steps(texts):
                found = [shingle_set(t) for t in texts[i:j]]
                yield record_batch(schema, b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), [len(x) for x in found], [x.tobytes() for x in found])

    def match(task: pa.Table) -> Match:
        return like([np.frombuffer(x, dtype=np.uint64) for x in task.column(1).to_pylist()])

    sets = shared.table(rows.mapInArrow(run, "g long, node long, n long, found binary"), "sets")
    return link_groups(sets, match, shared, "like", block, F.col("n"))


def members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, sets: int = SETS) -> DataFrame:
    """``(key, id, node, times, cluster)``, a row for each distinct id and text of ``docs``: the components of ``similar``, by name."""
    shared = Shared.create(docs.sparkSession, "similar")
    words = [f"f{k}" for k in range(WIDE)]
    prints = shared.table(set_prints(docs, id_col, text_col), "prints")
    units = shared.table(prints.groupBy("key", "id", "node").agg(F.count("*").alias("times")), "units")
    known = shared.table(prints.where("n > 0").select("node", *words, "bands").dropDuplicates(["node"]), "known")
    dealt = known.select(F.explode("bands").alias("g"), "node", *words)
    proposed = components(near_links(dealt, SIMILAR_RADIUS, shared, block), shared, "proposed")
    proposed = shared.table(proposed.union(proposed.select("root", "root")).distinct(), "proposed")
    joined = components(similar_links(docs, id_col, text_col, units, proposed, shared, sets), shared, "joined")
    return units.join(joined, "node", "left").select("key", "id", "node", "times", F.coalesce("root", "node").alias("cluster"))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(key, doc_id, node, times, component_id, cluster)``, a row for each distinct id and text of ``docs``.

    ``component_id`` is the smallest id that can be reached over pairs of a Jaccard similarity of
    0.8 or more (sets of 5-word shingles, A-Z lower-cased); ``cluster`` names the component even
    where no row of it has an id.  ``times`` counts the rows with this id and text.

    Texts with equal sets are one node; null and wordless texts are one node that is like no other.
    A text of fewer than five words is one shingle.  An empty table gives an empty table; other
    columns are ignored.
    """
    found = members(docs, id_col, text_col, **options)
    named = found.groupBy("cluster").agg(F.min("id").alias("component_id"))
    return found.join(named, "cluster").select("key", F.col("id").alias("doc_id"), "node", "times", "component_id", "cluster")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with one document of each component of ``similar`` left: the one with the smallest id.

    Of repeated rows with that id one stays.  A component without ids keeps one of its rows.  Null
    and wordless texts are one component.  All columns stay, whatever their names; an empty table
    gives an empty table.
    """
    shared = Shared.create(docs.sparkSession, "dedup")
    least = F.min(F.struct(F.col("id").isNull(), "id", "key", "times")).alias("r")
    stay = shared.table(members(docs, id_col, text_col, **options).groupBy("cluster").agg(least).select("r.key", "r.id", "r.times"), "stay")
    return chosen(docs, id_col, text_col, stay)
