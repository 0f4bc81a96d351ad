"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme values.

A word is looked up by itself and by its beginnings of four to six characters ("units").  The
score of a unit is its log-odds (of documents that hold it, so that no text counts twice) between toxic and clean documents under a Dirichlet prior, kept
only where it is significantly positive; all other words score a small negative constant.  One
linear scan finds every maximal-scoring segment of a text (Ruzzo and Tompa), and the segments'
chance under clean text follows from Karlin-Altschul statistics: a segment of score S in n words
has S' = lambda * S - ln(K * n), and is expected exp(-S') times by chance.  The significant S' of
a document add up to its evidence, and a logistic curve over the evidence's logarithm, fitted on
the sample, makes it a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Shared, as_bytes, hashed_sample, id_mod, record_batch

#: Parameters.  At most SAMPLE labelled texts of each class are fitted.
SAMPLE, Z, NEUTRAL, EXPECT, THRESHOLD = 4000, 3.09, 0.3, 0.05, 0.7
PRIOR_FLOOR, PRIOR_MASS = 0.5, 100.0
PREFIXES = (4, 5, 6)
EDGES = ".,;:!?|\"'()[]{}<>*-_"
CACHE = 300_000


def units(word: bytes) -> list[str]:
    """The word without edge punctuation, and its beginnings, marked by length; [] if nothing is left."""
    w = word.decode("utf-8", "replace").strip(EDGES)
    return [f"={w}", *(f"{n}{w[:n]}" for n in PREFIXES if len(w) >= n)] if w else []


def segments(scores: list[tuple[int, float]], n: int, neutral: float = NEUTRAL) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``(first, last, score)`` of a text of ``n`` words.

    ``scores`` are the positions with a positive score, in order; every other word scores -neutral.
    """
    firsts: list[int] = []
    lasts: list[int] = []
    lows: list[float] = []  # the sum of all scores before the segment
    highs: list[float] = []  # and with it
    lower: list[int] = []  # the nearest earlier segment with a lower sum before it; all between can be passed over
    total, last = 0.0, -1
    for at, s in scores:
        total -= neutral * (at - last - 1)
        first, low, high = at, total, total + s
        total, last = high, at
        j = len(firsts) - 1
        while True:
            while j >= 0 and lows[j] >= low:
                j = lower[j]
            if j < 0 or highs[j] >= high:
                break
            first, low, k, j = firsts[j], lows[j], j, lower[j]
            for held in (firsts, lasts, lows, highs, lower):
                del held[k:]
        for held, x in ((firsts, first), (lasts, at), (lows, low), (highs, high), (lower, j)):
            held.append(x)
    return [(a, z, high - low) for a, z, low, high in zip(firsts, lasts, lows, highs)]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    neutral: float = NEUTRAL
    rate: float = 1.0  # lambda
    scale: float = 0.1  # K
    slope: float = 1.0
    offset: float = -4.0

    def __post_init__(self):
        self._cache: dict[bytes, float] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_cache"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._cache = {}

    def word(self, w: bytes) -> float:
        """The largest weight of the word's units, 0 for a neutral word."""
        weights = self.weights
        return max([weights.get(u, 0.0) for u in units(w)], default=0.0)

    def hits(self, words: list[bytes]) -> list[tuple[int, float]]:
        """Positions and weights; a word's k-th occurrence weighs a k-th, so that repeats alone prove little."""
        cache, out, times = self._cache, [], {}
        if len(cache) > CACHE:
            cache.clear()
        for i, w in enumerate(words):
            s = cache.get(w)
            if s is None:
                s = cache[w] = self.word(w)
            if s:
                k = times[w] = times.get(w, 0) + 1
                out.append((i, s / k))
        return out

    def passages(self, text: bytes) -> tuple[int, list[tuple[int, int, float]]]:
        """Words of the text, and its significant passages (first word, last word, S')."""
        words = text.lower().split()
        n = len(words)
        if not n:
            return 0, []
        least = -np.log(EXPECT)
        base = np.log(max(self.scale * n, 1e-9))
        found = ((a, z, self.rate * s - base) for a, z, s in segments(self.hits(words), n, self.neutral))
        return n, [x for x in found if x[2] >= least]

    def score(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * np.log1p(evidence) + self.offset))))


# -- fitting --------------------------------------------------------------------------------


def _karlin(scores: np.ndarray, share: np.ndarray) -> float:
    """lambda > 0 with sum(share * exp(lambda * score)) = 1; the mean score is negative."""
    low, high = 1e-6, 1.0
    while (share * np.exp(np.minimum(high * scores, 700))).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (share * np.exp(np.minimum(mid * scores, 700))).sum() < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> tuple[float, float]:
    """Platt's curve by Newton steps; targets are smoothed, so that separable classes stay finite."""
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 0.1, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([((target - p) * x).sum() - ridge * a, (target - p).sum()])
        w = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -2, 2))
    return max(a, 1e-3), b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled documents of each class whose crc32(id) mod 3 isn't 1.

    The sample is drawn by a hash of the id and written to the shared folder; an id that is repeated
    with other texts counts with one of them, equal texts count once.  Counts of units are made in Spark, and only significant units come to the driver.
    Without documents of both classes every score is below the threshold.
    """
    spark = docs.sparkSession
    ids: dict[int, int] = {}
    for toxic in (0, 1):
        picked = labels.where((F.col(label_col) == toxic) & F.col(id_col).isNotNull() & (id_mod(id_col, 3) != 1)).select(id_col).distinct()
        ids.update((r[0], toxic) for r in hashed_sample(picked, id_col, sample).collect())
    if len(set(ids.values())) < 2:
        return Model()
    shared = Shared.create(spark, "toxicity")
    toxic_ids = [i for i, y in ids.items() if y]
    fitted = docs.where(F.col(id_col).isin(list(ids))).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    fitted = fitted.groupBy("i").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t"))  # one text for an id, in any order of rows
    fitted = fitted.select("t", F.col("i").isin(toxic_ids).cast("int").alias("y"))
    fitted = shared.table(fitted.groupBy(F.xxhash64("t"), "y").agg(F.first("t").alias("t")).select("t", "y"), "fitted")

    schema = pa.schema([("unit", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list[int]] = {}
            both = (Counter(), Counter())
            for t, y in zip(as_bytes(b.column(0)), b.column(1).to_pylist()):
                both[y].update(set(t.lower().split()))
            for y, words in enumerate(both):
                for w, n in words.items():  # n documents hold it
                    for u in units(w):
                        found.setdefault(u, [0, 0])[y] += n
            if found:
                yield record_batch(schema, list(found), [v[1] for v in found.values()], [v[0] for v in found.values()])

    counts = shared.table(fitted.mapInArrow(count, "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "counts")
    family = F.substring("unit", 1, 1)
    totals = F.broadcast(counts.groupBy(family.alias("family")).agg(F.sum("toxic").alias("n_toxic"), F.sum("clean").alias("n_clean")))  # four rows
    odds = counts.join(totals, family == F.col("family"))
    prior = PRIOR_FLOOR + PRIOR_MASS * (F.col("toxic") + F.col("clean")) / (F.col("n_toxic") + F.col("n_clean"))
    mass = PRIOR_MASS + PRIOR_FLOOR
    odds = odds.withColumn("prior", prior)
    log_odds = [F.log((F.col(k) + F.col("prior")) / (F.col(f"n_{k}") + mass - F.col(k) + 1.0)) for k in ("toxic", "clean")]
    odds = odds.select("unit", (log_odds[0] - log_odds[1]).alias("delta"), (1 / (F.col("toxic") + F.col("prior")) + 1 / (F.col("clean") + F.col("prior"))).alias("variance"))
    rows = odds.where((F.col("delta") > 1.0) & (F.col("delta") > Z * F.sqrt("variance"))).select("unit", "delta").collect()
    model = Model({r.unit: float(r.delta) for r in rows})

    tallied = pa.schema([("y", pa.int32()), ("n", pa.int64()), ("best", pa.float64()), ("hits", pa.list_(pa.float64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, y in zip(as_bytes(b.column(0)), b.column(1).to_pylist()):
                words = t.lower().split()
                hits = model.hits(words)
                best = max((s for _, _, s in segments(hits, len(words), model.neutral)), default=0.0)
                yield record_batch(tallied, [y], [len(words)], [best], [[s for _, s in hits] if not y else []])

    seen = fitted.mapInArrow(scan, "y int, n long, best double, hits array<double>").collect()
    clean = [r for r in seen if not r.y]
    words = max(1, sum(r.n for r in clean))
    hits = np.array(sorted(s for r in clean for s in r.hits))
    scores = np.concatenate([hits, [max(model.weights.values(), default=1.0), -model.neutral]])
    share = np.concatenate([np.full(len(hits), 1.0), [1.0, max(1, words - len(hits))]]) / (words + 1)
    if (share * scores).sum() < 0:
        model.rate = _karlin(scores, share)
    reached = [model.rate * r.best - np.log(r.n) for r in clean if r.best > 0 and r.n]
    if len(reached) >= 30:  # a Gumbel variable's mean lies Euler's constant above its mode
        share_hit = len(reached) / max(1, len(clean))
        model.scale = float(np.exp(np.clip(np.mean(reached) - 0.5772, -12, 2)) * share_hit)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sum(s for _, _, s in model.passages(t)[1]) for t in as_bytes(b.column(0))]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.float64())], names=["y", "x"])

    seen = fitted.mapInArrow(weigh, "y int, x double").collect()
    model.slope, model.offset = _logistic(np.log1p(np.array([r.x for r in seen])), np.array([r.y for r in seen]))
    return model


# -- the operators --------------------------------------------------------------------------


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, score, predicted, n_passages, toxic_words)`` for each row.

    Null, empty and wordless texts get the score of a text without passages.  A text of any length is
    scanned in linear time.  Repeated rows give a row each; an empty table gives an empty table; other
    columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_passages", pa.int64()), ("toxic_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.passages(t)[1] for t in as_bytes(b.column(1))]
            score = np.array([model.score(sum(s for _, _, s in x)) for x in found])
            yield record_batch(schema, b.column(0), score, (score >= threshold).astype(np.int32), [len(x) for x in found], [sum(z - a + 1 for a, z, _ in x) for x in found])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double, predicted int, n_passages long, toxic_words long")


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every significant passage: ``(doc_id, first_word, last_word, significance)``.

    Null, empty and clean texts have none, repeated rows have theirs again, an empty table has none.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("significance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *x) for i, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1))) for x in model.passages(t)[1]]
            if rows:
                yield record_batch(schema, *map(list, zip(*rows)))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, first_word long, last_word long, significance double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns, whatever their names.

    Null and empty texts stay, as they hold no passage; repeated rows stay or go together; an empty
    table gives an empty table.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stay = [model.score(sum(s for _, _, s in model.passages(t)[1])) < threshold for t in as_bytes(b.column(at))]
            yield b.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
