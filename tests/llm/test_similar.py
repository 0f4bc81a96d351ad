import random

import numpy as np

import corpus_pipeline
from millrace.llm import simhash
from millrace.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_kept(rows):
    """rows: [(id, text)] -> smallest ids of the components, by brute force."""
    found = [plain_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(found):
        for j, b in enumerate(found[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def edited(seed=3, n=25):
    """Texts with copies of which ever more words are replaced, on both sides of 0.8, and chains of them."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((4, 6, 40, 120, 300)))]
        out.append(" ".join(words))
        for k in range(5):
            words = list(words)
            for i in rng.sample(range(len(words)), min(k, len(words) // 20)):
                words[i] = f"x{rng.randrange(5000)}"
            out.append(" ".join(words).upper() if k == 2 else " ".join(words))
    return [(i, t) for i, t in enumerate(out)]


def test_stage_equals_brute_force(spark, sf):
    rows = edited()
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS)
    want = plain_kept(rows)
    assert 25 <= len(want) < len(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()) == want
    for block, sets in ((40, 2000), (8192, 400)):
        assert sorted(r.doc_id for r in simhash.deduplicate(docs, block=block, sets=sets).collect()) == want


def test_stage_on_documents(spark, sf):
    docs = table(spark, sf, "documents")
    want = plain_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()) == want


def pairs(n, size, common, seed=0):
    rng = np.random.default_rng(seed)
    for _ in range(n):
        both = rng.integers(0, 1 << 63, common, dtype=np.uint64) * np.uint64(2)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 63, k, dtype=np.uint64)]) for k in ((size - common) // 2, -(-(size - common) // 2)))
        yield np.unique(a), np.unique(b)


def met(a, b):
    near = sum((x ^ y).bit_count() for x, y in zip(simhash.wide_fingerprint(a), simhash.wide_fingerprint(b))) <= simhash.SIMILAR_RADIUS
    return near and bool((simhash.band_keys(a) == simhash.band_keys(b)).any())


def test_similar_names_components(spark):
    rows = edited()
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows] + [(None, rows[0][1], "en", "a", 1)], DOCS)
    found = simhash.similar(docs).collect()
    assert len(found) == len(rows) + 1 and all(r.times == 1 for r in found)
    assert sorted({r.component_id for r in found}) == plain_kept(rows)
    assert len({r.cluster for r in found}) == len(plain_kept(rows))
    assert {r.component_id for r in found if r.doc_id is None} == {r.component_id for r in found if r.doc_id == 0}


def test_few_pairs_are_missed():
    """Pairs at the least similarity share a bucket and lie within the radius; others hardly ever do."""
    for size, common in ((10, 8), (40, 32), (300, 240)):
        assert sum(met(a, b) for a, b in pairs(500, size, common)) >= 498
    assert sum(met(a, b) for a, b in pairs(500, 5, 4)) >= 490
    assert sum(met(a, b) for a, b in pairs(300, 300, 0)) == 0
    assert sum(met(a, b) for a, b in pairs(300, 300, 100)) < 30


def test_a_hot_group_of_copies(spark):
    """Near copies of one text and repeated rows, far above the block."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(60)] = f"x{i % 150}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(5000 + i, f"alone {i} " * 3) for i in range(40)] + [(7, "same words in every row of this one")] * 200
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOCS)
    want = plain_kept(rows)
    assert sorted(r.doc_id for r in simhash.deduplicate(docs, block=16, sets=300).collect()) == want


def test_odd_rows(spark):
    text = "one two three four five six seven eight"
    rows = [(3, text, "en", "a", 1), (3, text, "en", "a", 1), (1, None, None, None, None), (2, "", "en", "a", 0), (9, " \n\t", None, "b", 2), (None, text, None, None, None), (None, "alone " * 9, None, None, None), (None, "alone " * 9, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS node", "2 AS id", "3 AS root", "4 AS KEY", "5 AS times", "6 AS wanted_id", "map('a', 1) AS g")
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, None]
    assert simhash.deduplicate(docs.limit(0)).count() == 0
