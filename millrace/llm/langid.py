"""Language identification by error-correcting output codes over byte n-grams.

Each language gets a codeword of +1 and -1.  For every bit a logistic classifier over hashed byte
n-grams predicts that bit.  A text's language is the one whose codeword has the least
weighted loss, where a bit's loss weighs as much as its classifier was right on held-back rows of
the sample, for that language; texts whose two best codewords are close are flagged.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import as_bytes, id_mod, record_batch

#: Parameters.  At most SAMPLE labelled texts of each language are fitted.
SAMPLE, SIZE, ORDERS, MARGIN = 400, 8192, (1, 2, 3, 4), 0.25
UNDETERMINED = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_PIECE = 1 << 20


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


def profile(text: bytes) -> np.ndarray:
    """Counts of hashed n-grams of the whole text, lower-cased in ASCII, piece by piece."""
    out = np.zeros(SIZE, dtype=np.int64)
    text = text.lower()
    for at in range(0, len(text), _PIECE):
        a = np.frombuffer(text, dtype=np.uint8, count=min(_PIECE + max(ORDERS) - 1, len(text) - at), offset=at).astype(np.uint32)
        limit = min(_PIECE, len(text) - at)
        key = np.zeros(len(a), dtype=np.uint32)
        for k in range(max(ORDERS)):
            n = k + 1
            if len(a) < n:
                break
            key = key[: len(a) - k] * np.uint32(0x01000193) + a[k:] + np.uint32(n)
            if n in ORDERS:
                spread = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
                out += np.bincount(spread[:limit], minlength=SIZE)
    return out


def scaled(counts: np.ndarray) -> np.ndarray:
    """Rows of square roots of shares: long and short texts alike."""
    x = np.sqrt(counts.astype(np.float32))
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """[n, bits] of +1 and -1: every split of the languages up to seven, else the best of random codes."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.float32)
    if n <= 7:
        bits = (1 << (n - 1)) - 1
        return np.array([[1 if i == 0 or not (c >> (i - 1)) & 1 else -1 for c in range(1, bits + 1)] for i in range(n)], dtype=np.float32)
    rng, best, gap = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], dtype=np.float32), size=(n, bits))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        product = code @ code.T
        np.fill_diagonal(product, -bits)
        least = (bits - product.max()) / 2
        if least > gap:
            best, gap = code, least
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # [langs, bits]
    weights: np.ndarray  # [SIZE, bits]
    bias: np.ndarray  # [bits]
    trust: np.ndarray  # [langs, bits], rows sum to 1
    sharpness: float = 1.0

    def losses(self, x: np.ndarray) -> np.ndarray:
        margins = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None])
        return (loss * self.trust[None]).sum(axis=2)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its probability, and whether the next one is close."""
        e = -self.losses(x) * self.sharpness
        e = np.exp(e - e.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        top = p[np.arange(len(p)), best]
        second = np.where(np.arange(p.shape[1])[None] == best[:, None], 0, p).max(axis=1)
        return best, top, top - second < MARGIN


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], rounds: int = 120, rate: float = 0.5) -> Model:
    code = codewords(len(langs))
    back = np.arange(len(x)) % 5 == 0
    if len(np.unique(y[~back])) < len(langs):
        back[:] = False
    target = code[y]
    share = np.bincount(y, minlength=len(langs))
    weight = (1 / np.maximum(share, 1))[y][:, None].astype(np.float32)

    def descend(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
        m = [np.zeros_like(w), np.zeros_like(b)]
        v = [np.zeros_like(w), np.zeros_like(b)]
        xs, ts, ws = x[rows], target[rows], weight[rows] / weight[rows].sum()
        for k in range(1, rounds + 1):
            g = -ts / (1 + np.exp(np.clip(ts * (xs @ w + b), -30, 30))) * ws
            for i, (p, gp) in enumerate(((w, xs.T @ g + 1e-6 * w), (b, g.sum(axis=0)))):
                m[i] = 0.9 * m[i] + 0.1 * gp
                v[i] = 0.99 * v[i] + 0.01 * gp * gp
                p -= rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-8)
        return w, b

    w, b = descend(np.flatnonzero(~back))
    judged = back if back.any() else ~back
    right = ((x[judged] @ w + b) * target[judged] > 0).astype(np.float64)
    trust = np.stack([(right[y[judged] == i].sum(axis=0) + 1) / ((y[judged] == i).sum() + 2) for i in range(len(langs))])
    return Model(langs, code, w, b, trust / trust.sum(axis=1, keepdims=True), float(code.shape[1]))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Fits on at most ``sample`` texts of each language among documents whose crc32(id) mod 5 isn't 0.

    A text is drawn by a hash of itself, and equal texts of a language count once, so repeated rows
    and repeated ids change nothing, nor does the rows' order.  A text that stands under several
    languages speaks for each.  None if no row has both a text with a letter and a language.
    """
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    rows = docs.where(F.col(id_col).isNotNull() & (id_mod(id_col, 5) != 0)).select(text.alias("t"), lang.alias("lang")).where("t IS NOT NULL AND lang IS NOT NULL")
    share = F.shiftrightunsigned(F.xxhash64("t", F.lit(5)), 11) * 2.0**-53
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("t", 0.02).alias("n")).collect()}
    if not sizes:
        return None
    bound = F.lit(0.0)
    for name, n in sorted(sizes.items()):  # a fifth more than are wanted, so that few rows leave their tasks
        bound = F.when(F.col("lang") == name, min(1.0, (1.2 * sample + 64) / max(n, 1) * 1.1)).otherwise(bound)
    few = rows.withColumn("share", share).where(F.col("share") < bound).dropDuplicates(["lang", "t"])
    order = Window.partitionBy("lang").orderBy("share", "t")
    few = few.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample)
    schema = pa.schema([("lang", pa.string()), ("share", pa.float64()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(as_bytes(b.column(2))):
                if has_letter(t):
                    yield record_batch(schema, b.column(0).slice(i, 1), b.column(1).slice(i, 1), [zlib.compress(np.minimum(profile(t), 65535).astype(np.uint16).tobytes(), 1)])

    found = few.select("lang", "share", "t").mapInArrow(run, "lang string, share double, x binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r.share, r.lang, bytes(r.x)))
    langs = sorted({r.lang for r in found})
    x = np.stack([scaled(np.frombuffer(zlib.decompress(r.x), np.uint16)) for r in found])
    return fit(x, np.array([langs.index(r.lang) for r in found]), langs)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, ambiguous)`` for each row.

    Null texts and texts without a letter are ``und`` with score 0, and so are all if there is no
    model.  Repeated rows give a row each; an empty table gives an empty table; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(1))
            for a in range(0, len(texts), 256):
                part = texts[a : a + 256]
                lang, score, close = [UNDETERMINED] * len(part), np.zeros(len(part)), np.ones(len(part), bool)
                rows = [i for i, t in enumerate(part) if model is not None and has_letter(t)]
                if rows:
                    best, p, near = model.predict(np.stack([scaled(profile(part[i])) for i in rows]))
                    score[rows], close[rows] = np.clip(p, 0, 1), near
                    for i, k in zip(rows, best):
                        lang[i] = model.langs[k]
                yield record_batch(schema, b.column(0).slice(a, len(part)), lang, score, close)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
