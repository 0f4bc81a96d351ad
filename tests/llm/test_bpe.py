import hashlib
import random

import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe
from millrace.llm.common import table
from millrace.llm.queries import op10_bpe

PATH = bpe.tokenizer_path()
SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéñ"
    yield "a" * 30_000
    yield "".join(rng.choice(letters) for _ in range(20_000))
    yield "".join(rng.choice("ab") for _ in range(5000)) + SPECIAL * 3 + "".join(rng.choice("01") for _ in range(5000))
    yield "漢字かな交じり文" * 900 + "　" + "😀👩‍👩‍👧" * 700
    yield " " * 7000 + "x" + "\n\t " * 2000 + "'s'll've" * 900
    yield " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(6000)) + "  \n" + SPECIAL
    yield "".join(rng.choice(["the", "ing", "tion", "un", "é", "'s", "12", "!!", "Th", "<|", SPECIAL]) for _ in range(9000))
    yield "".join(rng.choice("abc123!?'  \n  \x1c\x85é") for _ in range(20_000))


@pytest.mark.parametrize("long,leaf", [(200, 16), (2000, 100), (1 << 16, 1 << 12)])
def test_long_texts_equal_the_library(library, long, leaf):
    own = bpe.Bpe(PATH, long=long, leaf=leaf)
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode_batch([text])[0] == want
        assert own.encode_unsplit(text) == want
        assert own.decode(want) == library.decode(want, skip_special_tokens=False) == text


def test_ranked_encoder_equals_the_library(library):
    own = bpe.Bpe(PATH)
    rng = random.Random(12)
    latin = [chr(i) for i in range(256)]
    texts = [a + b for a in latin for b in latin] + ["".join(rng.choices(latin, k=200)) for _ in range(300)]
    texts += ["".join(rng.choices("ab 'stl\n\t\x1c\x85\xa01é²ª", k=300)) for _ in range(300)]
    texts += [" ".join("".join(rng.choices("etaoinshrdluäöüß", k=rng.randint(1, 14))) for _ in range(300)) for _ in range(60)]
    assert all(map(own._suits_ranked, texts))
    assert own.encode_batch(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for other in ("漢字", "x" * 500, " " * 500, f"a {SPECIAL}"):
        assert not own._suits_ranked(other)


def test_joins_grow_their_windows(library):
    own = bpe.Bpe(PATH)
    rng = random.Random(8)
    for _ in range(300):
        word = "".join(rng.choice(["the", "er", "in", "ing", "a", "b", "tion", "s"]) for _ in range(rng.randint(2, 60)))
        at = rng.randint(1, len(word) - 1)
        assert own.join(*own._raw([word[:at], word[at:]])) == library.encode(word, add_special_tokens=False).ids


def test_bytes_that_are_no_text(library):
    own = bpe.Bpe(PATH)
    for ids in ([0, 200, 187, 50256, 221], [], [50256], [128, 129, 40, 255]):
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def digests(library, i, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_query_equals_the_library(spark, sf, library):
    want = {digests(library, r.doc_id, r.text) for r in table(spark, sf, "documents").collect()}
    assert {tuple(r)[:4] for r in op10_bpe(spark, sf).collect()} == want


def test_trees_run_through_the_query(spark, tmp_path, library):
    """Long texts and unsplit stretches are joined from parts, the supplied ones too."""
    sf = "/root/testdata/sf0.01"
    lengths = {r.doc_id: len(r.text) for r in table(spark, sf, "documents").collect()}
    rows = {r.doc_id: r.joins for r in op10_bpe(spark, sf).collect()}
    long = [i for i, n in lengths.items() if n > bpe.LONG]
    assert len(long) > 3 and all(rows[i] >= 1 for i in long)
    texts = [(1, "é" * 9000), (2, "some words " * 40), (3, "漢字 " * 9000), (4, " ".join(f"w{i}" for i in range(9000))), (5, "x" * 4000 + " " + "y" * 4000)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op10_bpe(spark, str(tmp_path)).collect()}
    assert {tuple(r)[:4] for r in got.values()} == {digests(library, i, t) for i, t in texts}
    assert got[1].joins >= 2 and got[2].joins == 0 and got[3].joins >= 1 and got[4].joins >= 3 and got[5].joins == 0


def test_texts_are_halved_anywhere(library):
    """Cuts inside words, numbers, runs of spaces, contractions and special tokens; windows without a place to end at."""
    rng = random.Random(21)
    texts = list(odd_texts()) + ["".join(rng.choice(["can't ", "we'll", "  ", " ", "\n", "é", "字", "12345", "!?", "a", "tion", SPECIAL]) for _ in range(rng.randint(50, 900))) for _ in range(60)]
    texts += ["b" * 700 + " c" * 3 + "d" * 700, "one two " * 60 + "\n" * 300 + "three four " * 60]
    for long in (40, 128, 1000):
        own = bpe.Bpe(PATH, long=long, leaf=1 << 30)
        for text in texts:
            want = library.encode(text, add_special_tokens=False).ids
            assert own.tree_of_text(text) == want
            assert own.encode_batch([text])[0] == want


def test_odd_rows_and_round_trip(spark, library):
    rows = [(1, "a b", 5), (1, "a b", 5), (None, None, None), (3, "", 1), (4, SPECIAL + " x", 1), (5, "é" * 70_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = sorted((tuple(r)[:4] for r in bpe.round_trip(docs, PATH).collect()), key=str)
    assert got == sorted((digests(library, i, t) for i, t, _ in rows), key=str)
    back = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted((tuple(r) for r in back), key=str) == sorted(((i, t or "") for i, t, _ in rows), key=str)
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_unsplit_stretches_of_short_texts_are_trees(library, monkeypatch):
    own, seen = bpe.Bpe(PATH), []
    unsplit = own.encode_unsplit
    monkeypatch.setattr(own, "encode_unsplit", lambda text: seen.append(len(text)) or unsplit(text))
    for text in ("a few words " + "漢字" * 5000 + " and more", "a" * 5000, "字\n" * 4000):
        assert own.encode_batch([text])[0] == library.encode(text, add_special_tokens=False).ids
    assert len(seen) == 3 and min(seen) > bpe.LEAF


def test_ranks_need_every_joinable_pair_to_be_a_merge(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        said = json.load(f)
    assert bpe.Bpe(PATH).ranked is not None
    vocab = {c: i for i, c in enumerate(sorted(bpe._byte_alphabet()))}
    merges = [["b", "c"], ["a", "b"], ["ab", "c"]]  # ranks would join a and bc, which no merge does
    said["model"] |= {"vocab": vocab | {"".join(m): len(vocab) + i for i, m in enumerate(merges)}, "merges": merges}
    said["added_tokens"] = []
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(said, f)
    own = bpe.Bpe(path)
    assert own.encode_batch(["abc"])[0] == Tokenizer.from_file(path).encode("abc", add_special_tokens=False).ids
    assert own.ranked is None
