"""Queries over whole texts and vectors: nothing is cut before it is split, filtered or encoded."""

from urllib.parse import quote_plus

import pytest

from millrace.plans import catalogue

TEXT = "one two  three ~*é " * 30 + "last"


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(1, TEXT), (2, ""), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, [0.0] * 9 + [0.5]), (2, [0.1]), (3, [])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_every_word(spark, folder):
    rows = sorted(map(tuple, catalogue.queries()["unnest_array"](spark, folder).collect()))
    assert rows == [(1, i, w) for i, w in enumerate(TEXT.split(" "))] + [(2, 0, "")]


def test_every_component(spark, folder):
    assert sorted(map(tuple, catalogue.queries()["unnest_outer"](spark, folder).collect()), key=str) == [(1, 0.5), (2, None), (3, None)]


def test_every_character(spark, folder):
    rows = {r.doc_id: (r.ue, r.same) for r in catalogue.queries()["fn_url_text"](spark, folder).collect()}
    assert rows == {1: (quote_plus(TEXT, safe="*").replace("~", "%7E"), True), 2: ("", True), 3: (None, None)}
