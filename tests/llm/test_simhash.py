import random

import numpy as np
import xxhash

from millrace.llm import bitslice, simhash
from millrace.llm.common import Shared, table
from millrace.llm.queries import op2_simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=3):
    """fps: [(id, fp)] -> smallest id that can be reached, by brute force."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    roots = [find(i) for i in range(len(fps))]
    least = {}
    for r, (d, _) in zip(roots, fps):
        least[r] = min(least.get(r, d), d)
    return [least[r] for r in roots]


def test_query_equals_brute_force(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text").collect()
    fps = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    want = {(d, f"{f:016x}", c) for (d, f), c in zip(fps, plain_components(fps))}
    assert {tuple(r) for r in op2_simhash(spark, sf).collect()} == want


def near_sets(n, seed=1, chains=6):
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(n)}
    for _ in range(chains):
        x = rng.getrandbits(64)
        for _ in range(12):
            out.add(x)
            for b in rng.sample(range(64), 3):
                x ^= 1 << b
    return sorted(out)


def test_kernel_counts_exactly():
    rng = np.random.default_rng(0)
    for words in (1, 2):
        fps = rng.integers(0, 1 << 63, (200, words), dtype=np.uint64)
        near = fps[:150].copy()
        for k in range(6):
            near ^= (np.uint64(1) << rng.integers(0, 64, (150, words)).astype(np.uint64)) * (rng.random((150, words)) < 0.7)
            for radius in (0, 1, 2, 3, 4, 5, 7, 9, 36):
                passed = rng.integers(0, 1 << 63, (150, 4), dtype=np.uint64) if k % 2 else np.zeros((150, 4), np.uint64)
                rows, cells, found = bitslice.within(near, bitslice.bit_planes(fps), radius, passed)
                got = np.zeros((150, 4), np.uint64)
                got[rows, cells] = found
                got = np.unpackbits(got.view(np.uint8), axis=1, bitorder="little")[:, :200]
                skip = np.unpackbits(passed.view(np.uint8), axis=1, bitorder="little")[:, :200]
                want = np.bitwise_count(near[:, None] ^ fps[None]).sum(axis=2) <= radius
                assert (got.astype(bool) == (want & (skip == 0))).all()


def test_blocks_are_abandoned(monkeypatch):
    """Random fingerprints are out of reach after a part of the planes: the kernel must not read the others."""
    rng = np.random.default_rng(1)
    fps, read = rng.integers(0, 1 << 63, (4096, 1), dtype=np.uint64), []

    class Planes(np.ndarray):
        def __getitem__(self, k):
            read.append(k)
            return super().__getitem__(k).view(np.ndarray)

    bitslice.within(fps[:64], bitslice.bit_planes(fps[64:]).view(Planes), 3, np.zeros((64, 63), np.uint64))
    assert max(read) < 48


def test_every_pair_is_found_once():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 16, (150, 1), dtype=np.uint64)
    pairs = [tuple(sorted((i, int(j)))) for i, js in bitslice.matches(fps, 1, tile=7)(np.arange(150)) for j in js]
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if int(fps[i, 0] ^ fps[j, 0]).bit_count() <= 1}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    asks = np.array([3, 40, 149])
    pairs = {(i, int(j)) for i, js in bitslice.matches(fps, 1)(asks) for j in js}
    assert {tuple(sorted(p)) for p in pairs} == {p for p in want if set(p) & set(asks.tolist())}


def linked(pairs, nodes):
    parent = {f: f for f in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in pairs:
        parent[find(u)] = find(v)
    groups = {}
    for f in nodes:
        groups.setdefault(find(f), set()).add(f)
    return {frozenset(g) for g in groups.values()}


def test_buckets_parts_and_tables_lose_no_link(spark):
    fps = near_sets(700)
    least = plain_components([(f, f) for f in fps])
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = {}
    for f, c in zip(signed, least):
        want.setdefault(c, set()).add(f)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for n, block in ((len(fps), 8192), (len(fps), 50), (1 << 26, 8192), (1 << 36, 64)):
        shared = Shared.create(spark, "test")
        pairs = simhash.near_links(simhash.deal(df, simhash.bucket_masks(n)), 3, shared, block).collect()
        assert linked(pairs, signed) == set(map(frozenset, want.values()))


def test_a_large_group_costs_its_size(spark):
    """A bucket above the block: one dense group, one chain beside it and single rows."""
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    dense = {centre ^ (1 << rng.randrange(64)) for _ in range(600)} | {centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a)}
    fps = sorted(dense | set(near_sets(100, seed=4, chains=3)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = {}
    for f, c in zip(signed, plain_components([(f, f) for f in fps])):
        want.setdefault(c, set()).add(f)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    shared = Shared.create(spark, "test")
    pairs = simhash.near_links(simhash.deal(df, [0]), 3, shared, block=64).collect()
    assert linked(pairs, signed) == set(map(frozenset, want.values()))
    assert len(pairs) < 20 * len(fps)
    rest = spark.read.parquet(shared.uri("near-rest"))
    assert 0 < rest.count() < len(fps) / 2  # what hubs cover is compared with hubs alone


def test_odd_rows(spark):
    text = "one two three four five six seven eight"
    rows = [(3, text, "en", "a", 1), (3, text, "en", "a", 1), (1, None, None, None, None), (2, "", "en", "a", 0), (9, " \n\t", None, "b", 2), (None, text, None, None, None), (None, "alone " * 9, None, None, None), (None, "alone " * 9, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS fp", "2 AS id", "3 AS root", "4 AS key")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(3, 3), (3, 3), (1, 1), (2, 1), (9, 1), (None, 3), (None, None), (None, None)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_long_text():
    text = " ".join(random.Random(5).choice("abcdefgh") * 3 + str(i % 97) for i in range(70_000))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
