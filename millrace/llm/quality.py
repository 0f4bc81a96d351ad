"""Quality rules: counts over the text, and a linear-chain CRF that labels lines.

Every line with a word is a position of the chain; its two labels are *content* and
*boilerplate*.  Weights are fitted by maximum likelihood (forward-backward) on a bounded sample of
documents whose ``quality`` is known.  The lines' own labels aren't known: a document's label is
evidence for each of its lines, and must hold for most of them.  Fitting starts from lines by
themselves and then goes back and forth between labelling the lines (Viterbi, with that evidence)
and fitting the chain to them, so good documents may hold boilerplate and bad ones content, and the
chain's transition weights tell how labels follow each other.  Viterbi decoding marks the lines of
every whole text, and the share of words in content lines decides whether the document stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import as_bytes, hashed_sample, mix, record_batch, steps

#: Parameters.  ``SAMPLE`` documents of each label at most are fitted, on all of their lines.
MIN_WORDS, WINDOW, REPEAT_SHARE, CONTENT_SHARE = 10, 5, 20, 0.5
SAMPLE = 1000
#: What a document's label adds to the score of that label in each of its lines, and how often lines are labelled anew.
EVIDENCE, PASSES = 0.5, 3
SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))
_DIGITS = b"0123456789"
_ENDS = frozenset(b".!?:;,\"')")
N_FEATURES = 30


# -- lines ----------------------------------------------------------------------------------


def line_features(line: bytes, words: list[bytes], repeated: bool) -> list[int]:
    """The indices of the features that hold; feature 0 always does."""
    n, size = len(words), sum(map(len, words))
    out = [0]
    out.append(1 if n <= 2 else 2 if n <= 5 else 3 if n <= 10 else 4 if n <= 25 else 5)
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    share = symbols / size
    out.append(6 if not symbols else 7 if share < 0.03 else 8 if share < 0.1 else 9)
    mean = size / n
    out.append(10 if mean < 2.5 else 11 if mean < 4 else 12 if mean < 8 else 13 if mean < 14 else 14)
    distinct = len(set(words)) / n
    out.append(15 if distinct < 0.35 else 16 if distinct < 0.6 else 17 if distinct < 0.85 else 18)
    digits = len(line) - len(line.translate(None, _DIGITS))
    if digits:
        out.append(19 if digits / size < 0.2 else 20)
    out.append(21 if words[-1][-1] in _ENDS else 22)
    first = words[0][:1]
    out.append(23 if first.isupper() else 24 if first.islower() else 25)
    if repeated:
        out.append(26)
    if b"|" in line:
        out.append(27)
    if b"<" in line or b"{" in line or b"://" in line:
        out.append(28)
    if n > 1 and words[0] == words[1]:
        out.append(29)
    return out


@dataclass
class Lines:
    """The lines with words of some texts, in order: their features, words and texts."""

    features: np.ndarray  # bool[lines, N_FEATURES]
    words: np.ndarray  # words in the line
    text: np.ndarray  # index of the text


def measure(texts: list[bytes]) -> tuple[np.ndarray, Lines]:
    """int64[texts, 5]: words, code points in words, symbols, repeated lines, words in repeated windows."""
    out = np.zeros((len(texts), 5), dtype=np.int64)
    ids: dict[bytes, int] = {}
    of: list[np.ndarray] = []
    rows: list[int] = []
    cols: list[int] = []
    line_words: list[int] = []
    line_text: list[int] = []
    for i, t in enumerate(texts):
        words = t.split()
        joined = b"".join(words)
        out[i, 0] = len(words)
        out[i, 1] = len(joined.translate(None, _CONTINUED))
        out[i, 2] = len(t) - len(t.translate(None, SYMBOLS))
        of.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words)))
        seen: set[bytes] = set()
        for line in t.split(b"\n"):
            w = line.split()
            if not w:
                continue
            again = line in seen
            out[i, 3] += again
            seen.add(line)
            found = line_features(line, w, again)
            cols += found
            rows += [len(line_words)] * len(found)
            line_words.append(len(w))
            line_text.append(i)
    features = np.zeros((len(line_words), N_FEATURES), dtype=bool)
    features[rows, cols] = True
    out[:, 4] = repeat_words(of)
    return out, Lines(features, np.array(line_words, dtype=np.int64), np.array(line_text, dtype=np.int64))


def repeat_words(texts: list[np.ndarray], width: int = WINDOW) -> np.ndarray:
    """For each text (as word numbers): words inside a window that the text holds twice or more."""
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    total = int(lengths.sum())
    found = np.zeros(len(texts), dtype=np.int64)
    if total < width:
        return found
    words = np.concatenate(texts).astype(np.uint64)
    text = np.repeat(np.arange(len(texts)), lengths)
    at = np.flatnonzero(text[: total - width + 1] == text[width - 1 :])
    key = text[at].astype(np.uint64)
    for k in range(width):
        key = mix(key, words[at + k])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(total + 1, dtype=np.int64)
    edge[at[twice]] += 1
    edge[at[twice] + width] -= 1
    np.add.at(found, text[np.cumsum(edge[:-1]) > 0], 1)
    return found


# -- the chain ------------------------------------------------------------------------------


@dataclass
class Crf:
    unary: np.ndarray  # [N_FEATURES, 2]; label 0: content, 1: boilerplate
    move: np.ndarray  # [2, 2]

    @classmethod
    def indifferent(cls) -> Crf:
        """Without labelled documents every line is content."""
        unary = np.zeros((N_FEATURES, 2))
        unary[0, 0] = 1.0
        return cls(unary, np.zeros((2, 2)))


def _padded(lines: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    most = max(map(len, lines))
    x = np.zeros((len(lines), most, N_FEATURES), dtype=np.float32)
    for i, f in enumerate(lines):
        x[i, : len(f)] = f
    return x, np.array([len(f) for f in lines])


def _logadd(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - m).sum(axis=axis)) + np.squeeze(m, axis)


def likelihood(crf: Crf, x: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the lines' labels (int[documents, lines]), and its gradients."""
    n, most, _ = x.shape
    scores = x @ crf.unary.astype(np.float32)
    inside = np.arange(most)[None, :] < lengths[:, None]
    forward = np.zeros((n, most, 2))
    backward = np.zeros((n, most, 2))
    forward[:, 0] = scores[:, 0]
    for t in range(1, most):
        step = _logadd(forward[:, t - 1, :, None] + crf.move, 1) + scores[:, t]
        forward[:, t] = np.where(inside[:, t, None], step, forward[:, t - 1])
    for t in range(most - 2, -1, -1):
        step = _logadd(crf.move + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        backward[:, t] = np.where(inside[:, t + 1, None], step, 0)
    z = _logadd(forward[:, -1], 1)
    expected = np.exp(forward + backward - z[:, None, None]) * inside[..., None]
    seen = np.eye(2)[labels] * inside[..., None]
    g_unary = np.tensordot(x, seen - expected, axes=([0, 1], [0, 1]))
    pair = forward[:, :-1, :, None] + crf.move + (scores[:, 1:] + backward[:, 1:])[:, :, None, :]
    pair = np.exp(pair - z[:, None, None, None]) * inside[:, 1:, None, None]
    moved = np.einsum("nta,ntb->ab", seen[:, :-1], seen[:, 1:])  # lines outside have no label
    gold = (scores * seen).sum() + (moved * crf.move).sum()
    return float(gold - z.sum()), g_unary, moved - pair.sum(axis=(0, 1))


def relabel(crf: Crf, lines: list[np.ndarray], labels: list[int], evidence: float = EVIDENCE) -> list[np.ndarray]:
    """The best labels of the documents' lines, given the documents' own; a document that would lose its label keeps it in all lines."""
    text = np.repeat(np.arange(len(lines)), [len(f) for f in lines])
    own = np.array(labels)[text]
    every = np.concatenate(lines).astype(np.float64) @ crf.unary
    every[np.arange(len(own)), own] += evidence
    found = best_path(every, crf.move, text, len(lines))
    agrees = np.bincount(text, weights=found == own, minlength=len(lines)) * 2 > np.bincount(text, minlength=len(lines))
    found = np.where(agrees[text], found, own)
    return np.split(found.astype(np.int64), np.cumsum([len(f) for f in lines])[:-1])


def fit(lines: list[np.ndarray], labels: list[int], rounds: int = 80, rate: float = 0.15, ridge: float = 1e-3, passes: int = PASSES) -> Crf:
    """Weights by gradient ascent with per-weight step sizes; lines are labelled ``passes`` times."""
    kept = [(f, y) for f, y in zip(lines, labels) if len(f)]
    if len({y for _, y in kept}) < 2:
        return Crf.indifferent()
    lines, labels = [f for f, _ in kept], [y for _, y in kept]
    size = np.array([(len(f) - 1).bit_length() for f in lines])
    groups = [np.flatnonzero(size == k) for k in np.unique(size)]  # documents of like length, so that a long one pads few others
    padded = [_padded([lines[i] for i in of]) for of in groups]
    total = sum(map(len, lines))

    def ascend(crf: Crf, of_lines: list[np.ndarray], rounds: int, chained: bool) -> None:
        batches = []
        for of, (x, lengths) in zip(groups, padded):
            y = np.zeros(x.shape[:2], dtype=np.int64)
            for row, i in enumerate(of):
                y[row, : len(of_lines[i])] = of_lines[i]
            batches.append((x, lengths, y))
        moment, square = [0.0, 0.0], [0.0, 0.0]
        for k in range(1, rounds + 1):
            gradients = [sum(g) for g in zip(*(likelihood(crf, *batch)[1:] for batch in batches))]
            for i, (w, g) in enumerate(zip((crf.unary, crf.move), gradients)):
                if i and not chained:
                    continue
                g = g / total - ridge * w
                moment[i] = 0.9 * moment[i] + 0.1 * g
                square[i] = 0.99 * square[i] + 0.01 * g * g
                w += rate * (moment[i] / (1 - 0.9**k)) / (np.sqrt(square[i] / (1 - 0.99**k)) + 1e-8)

    crf = Crf(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    own = [np.full(len(f), y, dtype=np.int64) for f, y in zip(lines, labels)]
    ascend(crf, own, rounds, chained=False)
    before = None
    for k in range(passes):
        found = relabel(crf, lines, labels)
        if before is not None and all(np.array_equal(a, b) for a, b in zip(before, found)):
            break
        ascend(crf, found, rounds if k == 0 else rounds // 2, chained=True)
        before = found
    return crf


def viterbi(crf: Crf, lines: Lines, n_texts: int) -> np.ndarray:
    """The best label of every line."""
    return best_path(lines.features.astype(np.float64) @ crf.unary, crf.move, lines.text, n_texts)


def best_path(scores: np.ndarray, move: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """Viterbi; texts of like length are decoded together, a position at a time."""
    lengths = np.bincount(text, minlength=n_texts)
    starts = np.cumsum(lengths) - lengths
    out = np.zeros(len(scores), dtype=np.int8)
    size = np.where(lengths > 0, np.ceil(np.log2(np.maximum(lengths, 1))).astype(int), -1)
    for k in range(size.max(initial=-1) + 1):
        of = np.flatnonzero(size == k)
        if not len(of):
            continue
        length, start, most = lengths[of], starts[of], int(lengths[of].max())
        best = scores[start]
        back = np.zeros((most, len(of), 2), dtype=np.int8)
        for t in range(1, most):
            go = t < length
            ways = best[:, :, None] + move
            back[t] = ways.argmax(axis=1)
            step = ways.max(axis=1) + scores[np.minimum(start + t, len(scores) - 1)]
            best = np.where(go[:, None], step, best)
        label = best.argmax(axis=1)
        for t in range(most - 1, -1, -1):
            go = t < length
            out[(start + t)[go]] = label[go]
            if t:
                label = np.where(go, back[t, np.arange(len(of)), label], label)
    return out


def judge(crf: Crf, texts: list[bytes], content_share: float = CONTENT_SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The five counts, whether the counts fail, whether the document stays, and its content share."""
    counts, lines = measure(texts)
    labels = viterbi(crf, lines, len(texts))
    content = np.bincount(lines.text, weights=lines.words * (labels == 0), minlength=len(texts))
    share = content / np.maximum(counts[:, 0], 1)
    failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > REPEAT_SHARE * counts[:, 0])
    return counts, failed, ~failed & (share >= content_share), share


# -- the operator ---------------------------------------------------------------------------


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Crf:
    """Fits the chain on at most ``sample`` documents of each label, drawn by a hash of the id.

    An id that is repeated with other texts counts once, with the least of their features; an id with
    both labels is of the better one.  Neither depends on the rows' order.
    """
    ids: dict[int, int] = {}
    for quality in (0, 1):
        picked = labels.where((F.col(label_col) == quality) & F.col(id_col).isNotNull()).select(id_col).distinct()
        for r in hashed_sample(picked, id_col, sample).collect():
            ids[r[0]] = 1 - quality
    if not ids:
        return Crf.indifferent()
    schema = pa.schema([("id", pa.int64()), ("f", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1))):
                _, lines = measure([t])
                yield record_batch(schema, [i], [np.packbits(lines.features, axis=1).tobytes()])

    picked = docs.where(F.col(id_col).isin(list(ids))).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    width = -(-N_FEATURES // 8)
    rows = {r.id: r.f for r in picked.mapInArrow(run, "id long, f binary").groupBy("id").agg(F.min("f").alias("f")).collect()}
    lines = [np.unpackbits(np.frombuffer(rows[i], np.uint8).reshape(-1, width), axis=1)[:, :N_FEATURES] for i in sorted(rows)]
    return fit(lines, [ids[i] for i in sorted(rows)])


def quality(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text", content_share: float = CONTENT_SHARE) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share)`` for each row.

    Null and empty texts have no words: all counts 0, ``base_failed`` true, ``kept`` false, share 0.
    Repeated rows give a row each; an empty table gives an empty table; other columns are ignored.
    """
    spark_schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(1))
            for a, z in steps(texts):
                counts, failed, kept, share = judge(crf, texts[a:z], content_share)
                yield record_batch(schema, b.column(0).slice(a, z - a), *counts.T, failed, kept, share)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, spark_schema)


def keep_good(docs: DataFrame, crf: Crf, text_col: str = "text", content_share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, in one pass without a shuffle.

    Null, empty and wordless texts go (they fail the counts); repeated rows stay or go together; an
    empty table gives an empty table; columns may have any names.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(at))
            stay = [judge(crf, texts[a:z], content_share)[2] for a, z in steps(texts)]
            if stay:
                yield b.filter(pa.array(np.concatenate(stay)))

    return docs.mapInArrow(run, docs.schema)
