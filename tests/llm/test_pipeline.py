import hashlib
import math

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import bpe, quality, toxicity
from millrace.llm.common import table
from tests.llm.test_mixing import plain_copies
from tests.llm.test_quality import plain_counts, plain_verdict
from tests.llm.test_similar import plain_kept
from tests.llm.test_toxicity import plain_score

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, tmp_path):
    """Every stage on its own input, against plain code; weights are the operator's, what is done with them isn't."""
    docs = table(spark, SF, "documents")
    columns, seen, labels = docs.columns, {}, table(spark, SF, "labels")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = before, [(r.doc_id, r.text, r.source) for r in before.collect()], docs.collect()
        if name != "bpe":
            assert docs.columns == columns

    before, rows, kept = seen["quality_rules"]
    crf, want = quality.train(before, labels), []
    for i, text, _ in rows:
        n, _, _, _, repeated = plain_counts(text)
        if n >= 10 and 100 * repeated <= 20 * n and plain_verdict(crf, text) >= 0.5:
            want.append(i)
    assert sorted(r.doc_id for r in kept) == sorted(want) and 0 < len(want) < len(rows)

    before, rows, kept = seen["toxicity"]
    model = toxicity.train(before, labels)
    assert sorted(r.doc_id for r in kept) == sorted(i for i, text, _ in rows if plain_score(model, text) < 0.7)

    _, rows, kept = seen["near_duplicates"]
    assert sorted(r.doc_id for r in kept) == plain_kept([(i, t) for i, t, _ in rows])

    _, rows, mixed = seen["mixing"]
    want = plain_copies(rows)
    assert sorted(r.doc_id for r in mixed) == sorted(i for i, n in want.items() for _ in range(n))

    _, rows, found = seen["bpe"]
    library = Tokenizer.from_file(bpe.tokenizer_path())
    texts = {i: t for i, t, _ in rows}
    assert sorted(r.doc_id for r in found) == sorted(i for i, _, _ in rows)
    for r in found:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()

    final = sorted(map(str, corpus_pipeline.run(spark, SF).collect()))
    assert final == sorted(map(str, found))


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


ODD = [(-1, None, "en", "a", 1), (-2, "", "de", "a", 0), (-3, " \n\t", None, None, 3), (None, "some good words " * 9, "en", "b", 9), (None, "some good words " * 9, "en", "b", 9), (-4, "a plain sentence of words, and another one. " * 30_000, "en", "a", 1)]
CLASHES = ("key", "id", "node", "g", "n", "t", "times", "__stay", "__copies", "Own", "h", "m", "fp", "row", "turn", "kind", "wanted_id", "component_id", "cluster")


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_rows_and_clashing_names(spark, name, stage):
    """Nulls in every column, empty and very long texts, repeated rows, and columns that are named as the stages name theirs."""
    real = table(spark, SF, "documents")
    docs = real.unionByName(spark.createDataFrame(ODD, real.schema)).unionByName(real.limit(5))
    docs = docs.withColumns({c: F.lit(7) for c in CLASHES}).withColumn("properties", F.map_from_arrays(F.array(F.lit("k")), F.array(F.lit(1))))
    out = stage(spark, docs, SF)
    rows = out.collect()
    assert rows
    if name == "bpe":
        assert len(rows) == docs.count()
        assert {r.n_tokens for r in rows if r.doc_id in (-1, -2)} == {0}
        return
    assert out.columns == docs.columns
    ids = [r.doc_id for r in rows]
    assert all(r.key == 7 and r.properties == {"k": 1} for r in rows)
    want = {"quality_rules": (0, 0, 0), "toxicity": (1, 1, 1), "near_duplicates": (0, 0, 1)}
    if name in want:
        assert tuple(ids.count(i) for i in (-1, -2, -3)) == want[name]
    if name == "near_duplicates":
        assert ids.count(None) == 1 and ids.count(-4) == 1 and max(ids.count(i) for i in set(ids)) == 1
    if name == "mixing":
        assert max(ids.count(i) for i in set(ids) - {None}) <= 4 and ids.count(-4) <= 2 and not math.isnan(len(ids))
