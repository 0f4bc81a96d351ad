import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid
from millrace.llm.common import table
from millrace.llm.queries import op6_langid


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 12, 40])
def test_codewords_are_far_apart(n):
    code = langid.codewords(n)
    for i in range(n):
        for j in range(i):
            assert (code[i] != code[j]).sum() >= (1 if n == 2 else 2 ** max(0, n - 2) if n <= 7 else code.shape[1] // 5)


def test_profile_counts_every_piece(monkeypatch):
    text = ("Grüße aus der Ferne, " * 200).encode()
    whole = langid.profile(text)
    assert whole.sum() == sum(len(text) - n + 1 for n in langid.ORDERS)
    monkeypatch.setattr(langid, "_PIECE", 97)
    assert (langid.profile(text) == whole).all()
    assert langid.profile(b"").sum() == 0 and langid.profile(b"a").sum() == 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: (r.lang, r.text) for r in table(spark, sf, "documents").collect()}
    rows = op6_langid(spark, sf).collect()
    assert len(rows) == len(langs) and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == langs[r.doc_id][0] for r in rows if r.held_out]) > 0.97


def test_prediction_ignores_other_columns(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = langid.train(docs)
    a = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    b = {r.doc_id - 7: r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")).withColumn("doc_id", F.col("doc_id") + 7), model).collect()}
    assert a == b


def test_odd_rows(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = langid.train(docs)
    rows = [(1, None, 0), (2, "", 0), (3, "123 -- !!", 0), (4, "ß", 0), (5, "the and of " * 50_000, 0), (5, "the", 0), (None, "éé", 0), (6, "٣ ٤", 0)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = langid.identify(odd, model).collect()
    und = [r.doc_id for r in got if r.lang_pred == "und"]
    assert sorted(und) == [1, 2, 3, 6] and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert {r.lang_pred for r in got} <= {"und", *model.langs}
    assert langid.identify(odd.limit(0), model).count() == 0
    nothing = langid.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert nothing is None and {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}
    one = langid.train(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in langid.identify(odd.where("doc_id = 5"), one).collect()} == {"en"}


def test_repeated_ids_and_rows_change_nothing(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    mixed = docs.withColumn("doc_id", F.col("doc_id") % 7 + F.lit(1))  # few ids, each with many texts and languages
    models = [langid.train(d) for d in (mixed, mixed.unionAll(mixed).orderBy(F.rand(3)), mixed.repartition(5).orderBy(F.desc("text")))]
    assert len(models[0].langs) == 4
    for m in models[1:]:
        assert m.langs == models[0].langs and (m.weights == models[0].weights).all() and (m.trust == models[0].trust).all()
    assert np.mean([r.lang_pred == r.lang for r in langid.identify(docs, models[0]).join(docs, "doc_id").collect()]) > 0.9


def test_the_sample_is_bounded(spark):
    rows = [(i, f"wort{i} und {'x' * (i % 9)} haus", "de") for i in range(3000)] + [(i, f"word{i} and house", "en") for i in range(3000, 3040)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    fit = langid.fit
    try:
        langid.fit = lambda x, y, langs, **k: seen.append(np.bincount(y).tolist()) or fit(x, y, langs, **k)
        langid.train(docs, sample=50)
    finally:
        langid.fit = fit
    assert seen[0][0] == 50 and 25 <= seen[0][1] <= 40


def plain_prediction(model, text):
    """Bit by bit: margins over the text's own n-grams, then the codeword of the least weighted loss."""
    raw = (text or "").encode().lower()
    if not any(c.isalpha() for c in (text or "")):
        return "und", 0.0
    counts = {}
    for n in langid.ORDERS:
        for at in range(len(raw) - n + 1):
            key = 0
            for k, c in enumerate(raw[at : at + n], 1):
                key = (key * 0x01000193 + c + k) & 0xFFFFFFFF
            slot = (key * 0x9E3779B1 & 0xFFFFFFFF) >> 19
            counts[slot] = counts.get(slot, 0) + 1
    norm = math.sqrt(sum(counts.values()))
    margins = [float(model.bias[b]) + sum(math.sqrt(n) / norm * float(model.weights[s, b]) for s, n in counts.items()) for b in range(model.code.shape[1])]
    losses = [sum(float(t) * math.log1p(math.exp(-m * float(c))) for t, m, c in zip(trust, margins, code)) for trust, code in zip(model.trust, model.code)]
    e = [math.exp(-x * model.sharpness + min(losses) * model.sharpness) for x in losses]
    return model.langs[losses.index(min(losses))], max(e) / sum(e)


def test_query_equals_plain_decoding(spark, sf):
    docs = table(spark, sf, "documents")
    model = langid.train(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in op6_langid(spark, sf).collect():
        lang, score = plain_prediction(model, texts[r.doc_id])
        assert r.lang_pred == lang and r.score == pytest.approx(score, rel=1e-3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
