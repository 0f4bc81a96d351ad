import random
import re
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import quality
from millrace.llm.common import table
from millrace.llm.queries import op3_quality


def plain_counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    inside = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside)


def test_query_counts_equal_brute_force(spark, sf):
    want = {r.doc_id: plain_counts(r.text) for r in table(spark, sf, "documents").collect()}
    rows = op3_quality(spark, sf).collect()
    assert len(rows) == len(want)
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == want[r.doc_id]
        assert r.base_failed == (got[0] < 10 or 100 * got[4] > 20 * got[0])
        assert not (r.base_failed and r.kept)


def test_verdict_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    rows = [r for r in op3_quality(spark, sf).collect() if r.doc_id in labels and not r.base_failed]
    assert np.mean([r.kept == bool(labels[r.doc_id]) for r in rows]) > 0.95
    assert np.mean([r.kept for r in rows if labels[r.doc_id]]) > 0.98


def random_crf(seed):
    rng = np.random.default_rng(seed)
    return quality.Crf(rng.normal(size=(quality.N_FEATURES, 2)), rng.normal(size=(2, 2)))


def path_score(crf, features, labels):
    s = sum(features[t] @ crf.unary[:, y] for t, y in enumerate(labels))
    return s + sum(crf.move[a, b] for a, b in zip(labels, labels[1:]))


def test_viterbi_finds_the_best_of_all_paths():
    rng = np.random.default_rng(2)
    lengths = [0, 1, 2, 5, 7, 3, 8, 6]
    features = rng.random((sum(lengths), quality.N_FEATURES)) < 0.2
    text = np.repeat(np.arange(len(lengths)), lengths)
    for seed in range(4):
        crf = random_crf(seed)
        got = quality.viterbi(crf, quality.Lines(features, np.ones(len(text), int), text), len(lengths))
        for i, n in enumerate(lengths):
            f = features[text == i].astype(float)
            if n:
                best = max(product((0, 1), repeat=n), key=lambda p: path_score(crf, f, p))
                assert path_score(crf, f, tuple(got[text == i])) == pytest.approx(path_score(crf, f, best))


def test_likelihood_and_gradient():
    rng = np.random.default_rng(3)
    lines = [(rng.random((n, quality.N_FEATURES)) < 0.3).astype(np.float32) for n in (1, 4, 6)]
    crf = random_crf(9)
    x, lengths = quality._padded(lines)
    y = rng.integers(0, 2, x.shape[:2])
    value, g_unary, g_move = quality.likelihood(crf, x, lengths, y)
    want = 0.0
    for f, k in zip(lines, y):
        paths = [path_score(crf, f, p) for p in product((0, 1), repeat=len(f))]
        want += path_score(crf, f, tuple(k[: len(f)])) - np.log(np.sum(np.exp(paths)))
    assert value == pytest.approx(want, rel=1e-4)
    for array, gradient, at in ((crf.unary, g_unary, (3, 1)), (crf.move, g_move, (0, 1)), (crf.move, g_move, (1, 1))):
        array[at] += 1e-3
        up = quality.likelihood(crf, x, lengths, y)[0]
        array[at] -= 2e-3
        down = quality.likelihood(crf, x, lengths, y)[0]
        array[at] += 1e-3
        assert gradient[at] == pytest.approx((up - down) / 2e-3, rel=2e-2, abs=2e-2)


def test_odd_rows(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", f"x{i}", f"y{i}"]) for i in range(60_000))
    same = "a b c d e\n" * 3
    rows = [(1, None, 0), (2, "", 0), (3, " \n\t\n", 0), (4, long, 0), (5, same, 0), (5, same, 0), (None, "# é *\n\n# é *", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = quality.quality(docs, quality.Crf.indifferent()).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted((i or -1, *plain_counts(t)) for i, t, _ in rows)
    assert [r.kept for r in got if r.doc_id == 4] == [True]
    kept = quality.keep_good(docs, quality.Crf.indifferent())
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [4]
    empty = docs.limit(0)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality(empty, quality.train(empty, none)).count() == 0
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (77, 0)], "doc_id long, quality int")
    assert quality.quality(docs, quality.train(docs, labels)).count() == len(rows)


def sentence(rng):
    return " ".join(rng.choice(["plain", "words", "of", "the", "story", "went", "along"]) for _ in range(rng.randint(6, 14))).capitalize() + "."


def junk(rng):
    return " | ".join(rng.choice(["# *", "$ <a>", "Home", "&& 12", "Login"]) for _ in range(rng.randint(3, 8)))


def mixed_texts(rng, n):
    """Good texts of sentences, some with a footer, and bad ones of junk, some that begin with a sentence."""
    texts, labels, footers = {}, {}, {}
    for i in range(n):
        good, footer = i % 2, 3 * (i % 4 >= 2)
        own, other = (sentence, junk) if good else (junk, sentence)
        lines = [own(rng) for _ in range(rng.randint(6, 12))]
        odd = [other(rng) for _ in range(footer)]
        texts[i] = "\n".join(lines + odd if good else odd + lines)
        labels[i], footers[i] = good, footer
    return texts, labels, footers


def test_lines_have_labels_of_their_own(spark):
    """A footer in a good text is boilerplate and the first sentences of a bad one are content."""
    rng = random.Random(4)
    texts, labels, footers = mixed_texts(rng, 200)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    crf = quality.train(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"))
    right = []
    for text, good, footer in zip(*(x.values() for x in mixed_texts(random.Random(5), 100))):
        _, lines = quality.measure([text.encode()])
        found = quality.viterbi(crf, lines, 1)
        n = len(found)
        want = np.array([0] * (n - footer) + [1] * footer) if good else np.array([0] * footer + [1] * (n - footer))
        right.append((found == want).mean())
    assert np.mean(right) > 0.97
    shares = [r.content_share for r in quality.quality(docs, crf).collect()]
    assert sum(0 < s < 1 for s in shares) > 80
    assert abs(crf.move[0, 1] - crf.move[0, 0]) < 20 and crf.move[0, 0] > crf.move[0, 1] and crf.move[1, 1] > crf.move[1, 0]


def test_some_supplied_texts_are_mixed(spark, sf):
    rows = op3_quality(spark, "/root/testdata/sf0.01").collect()
    assert sum(0 < r.content_share < 1 for r in rows) >= 20


def plain_verdict(crf, text):
    """Content share by a plain dynamic programme over one text."""
    _, lines = quality.measure([(text or "").encode()])
    best = {0: (0.0, ()), 1: (0.0, ())}
    for t, row in enumerate(lines.features):
        unary = [sum(crf.unary[k, y] for k in np.flatnonzero(row)) for y in (0, 1)]
        best = {y: max((((s + crf.move[a, y]) if t else 0.0) + unary[y], path + (y,)) for a, (s, path) in best.items()) for y in (0, 1)}
    path = max(best.values())[1]
    return sum(w for w, y in zip(lines.words, path) if y == 0) / max(1, lines.words.sum())


def test_verdict_equals_a_plain_decoder(spark, sf):
    docs = table(spark, sf, "documents")
    crf = quality.train(docs, table(spark, sf, "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in op3_quality(spark, sf).collect():
        share = plain_verdict(crf, texts[r.doc_id])
        assert r.content_share == pytest.approx(share)
        assert r.kept == (not r.base_failed and share >= 0.5)


def test_all_lines_are_fitted(spark):
    """Lines far down a long text count as those at its top."""
    rng = random.Random(4)
    texts = {1: "\n".join(sentence(rng) for _ in range(300)), 2: "\n".join([sentence(rng)] * 100 + [junk(rng) for _ in range(200)]), 3: sentence(rng)}
    labels = {1: 1, 2: 0, 3: 1}
    crf = quality.train(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, quality int"))
    _, lines = quality.measure([texts[2].encode()])
    assert quality.viterbi(crf, lines, 1)[100:].all()


def test_repeated_ids_learn_the_same_in_any_order(spark):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    mixed = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1)).unionByName(docs)
    a, b = (quality.train(d, labels) for d in (mixed, mixed.repartition(7, F.rand(5)).sortWithinPartitions(F.desc("text"))))
    assert (a.unary == b.unary).all() and (a.move == b.move).all()
