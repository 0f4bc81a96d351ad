"""An interpolated modified Kneser-Ney language model over sorted hash arrays.

Words become numbers: the vocabulary is a sorted array of word hashes, in shards by the highest
bits, and a word's number is its place in it.  Workers count the n-grams of their rows as packed
arrays of numbers, dealt by the hash of the context, and one pass over the deals of an order

* adds up the counts and writes them as arrays sorted by context hash and word, with the totals of
  each context that several words follow (its count, and how many of them follow once and twice),
* hands on every distinct n-gram once, as a left extension of its suffix: the next lower order
  counts extensions instead of occurrences.

The last order is dense arrays by word number.  Contexts that may be very common (both of their
words are) are spread over several shards by the next word, and their totals are added up when
they are looked up.  Scoring maps the arrays from the shared folder into the workers' memory; pages
that aren't asked for are never read.

If there are very many shards, n-grams are dealt to ranges of them first and to the shards of a range
then, so that packs hold many n-grams however large the corpus is.

Counts take a byte, those of 255 and more stand in a side array.  No n-gram is dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Shared, as_bytes, mix, record_batch, signed, steps

#: Parameters: the order, n-grams of a shard at most about, bytes of text a step, bits of a memo's slots.
ORDER, SHARD, STEP, MEMO = 3, 1 << 20, 2 << 20, 19
#: Shards that n-grams are dealt to at once (beyond, in two steps), and files a worker keeps mapped.
WIDE, MAPPED = 1 << 12, 1 << 14
END = np.uint64(0x5851F42D4C957F2D)  # stands for the hash of a text's end
_SALT = np.uint64(0x9E3779B97F4A7C15)
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


# -- files of arrays ------------------------------------------------------------------------


def pack_arrays(**arrays: np.ndarray) -> Iterator[bytes]:
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = (at, a.dtype.str, len(a))
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    yield len(text).to_bytes(8, "little") + text
    for a in arrays.values():
        yield a.tobytes() + bytes(-a.nbytes % 8)


def map_arrays(shared: Shared, name: str) -> dict[str, np.ndarray]:
    raw = shared.map(name).view(np.ndarray)  # a view of the map, without its slower indexing
    n = int(raw[:8].view(np.uint64)[0])
    head = json.loads(raw[8 : 8 + n].tobytes())
    return {k: raw[8 + n + at : 8 + n + at + size * np.dtype(kind).itemsize].view(kind) for k, (at, kind, size) in head.items()}


def narrow(name: str, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes, and where they don't fit."""
    large = np.flatnonzero(counts >= 255)
    return {name: np.minimum(counts, 255).astype(np.uint8), f"{name}_at": large.astype(np.int64), f"{name}_is": counts[large].astype(np.int64)}


def widen(arrays: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    out = arrays[name][at].astype(np.int64)
    large = np.flatnonzero(out == 255)
    if len(large):
        out[large] = arrays[f"{name}_is"][np.searchsorted(arrays[f"{name}_at"], at[large])]
    return out


def pack_grams(grams: np.ndarray, counts: np.ndarray) -> bytes:
    """Rows of numbers, sorted, and their counts; columns apart, differences in the first."""
    parts = [len(grams).to_bytes(8, "little"), grams.shape[1].to_bytes(8, "little")]
    first = np.diff(grams[:, 0], prepend=0)
    columns = [first, *grams.T[1:], counts]
    press = zstandard.ZstdCompressor(level=1)
    raw = []
    for c in columns:
        wide = 4 if len(c) == 0 or (c.min() >= -(1 << 31) and c.max() < 1 << 31) else 8
        raw.append(bytes([wide]) + np.ascontiguousarray(c.astype(f"<i{wide}").view(np.uint8).reshape(-1, wide).T).tobytes())
    return b"".join(parts) + press.compress(b"".join(raw))


def unpack_grams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, order = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[16:]), np.uint8)
    out = np.empty((n, order + 1), dtype=np.int64)
    at = 0
    for k in range(order + 1):
        wide = int(raw[at])
        out[:, k] = np.ascontiguousarray(raw[at + 1 : at + 1 + n * wide].reshape(wide, n).T).view(f"<i{wide}").ravel()
        at += 1 + n * wide
    out[:, 0] = np.cumsum(out[:, 0])
    return out[:, :order], out[:, order]


def sorted_rows(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by the columns, and which rows of it differ from the one before.

    Two columns at a time become one number: the rank of what is sorted so far, and the next column.
    """
    n = len(columns[0])
    key = columns[0].astype(np.uint64)
    if len(columns) == 1 or n < 2:
        order = np.argsort(key)
        key = key[order]
        return order, np.concatenate([np.ones(min(n, 1), bool), key[1:] != key[:-1]])
    if max(int(c.max()) for c in columns[1:]) >= 1 << 32:
        order = np.lexsort(columns[::-1])
        new = np.zeros(n, bool)
        for c in columns:
            new[1:] |= c[order][1:] != c[order][:-1]
        new[0] = True
        return order, new
    rest = columns[1:]
    if int(key.max()) < 1 << 32:
        key, rest = key << np.uint64(32) | rest[0].astype(np.uint64), rest[1:]
    while True:
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        if not rest:
            return order, new
        key[order] = np.cumsum(new).astype(np.uint64)  # ranks, back in the rows' own order
        key, rest = key << np.uint64(32) | rest[0].astype(np.uint64), rest[1:]


def add_up(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows added up, sorted."""
    if not len(grams):
        return grams, counts
    order, new = sorted_rows(list(grams.T))
    first = np.flatnonzero(new)
    return grams[order[first]], np.add.reduceat(counts[order], first)


# -- vocabulary -----------------------------------------------------------------------------


def hash_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as hashes, an end after each text; and how many tokens each text has.

    All texts are split and hashed together, eight bytes of every word at a time.
    """
    data = b"\n".join(texts).lower() + bytes(9)  # eight bytes can be read from any place
    n = len(data) - 9
    body = np.frombuffer(data, np.uint8, n)
    inside = (body != 32) & (body - np.uint8(9) >= 5)
    change = np.zeros(n + 1, dtype=bool)
    if n:
        change[0], change[n] = inside[0], inside[-1]
        np.not_equal(inside[1:], inside[:-1], out=change[1:n])
    edges = np.flatnonzero(change)
    starts, ends = edges[::2], edges[1::2]
    size = ends - starts
    eight = np.ndarray((n + 1,), "<u8", data, strides=(1,))
    h = mix(eight[starts] & _LOW_BYTES[np.minimum(size, 8)], size.astype(np.uint64))
    rows = np.flatnonzero(size > 8)
    for at in range(8, 64, 8):
        if not len(rows):
            break
        left = size[rows] - at
        h[rows] = mix(h[rows], eight[starts[rows] + at] & _LOW_BYTES[np.minimum(left, 8)])
        rows = rows[left > 8]
    for r in rows:
        h[r] = mix(h[r : r + 1], xxhash.xxh64_intdigest(data[starts[r] + 64 : ends[r]]))[0]
    words = np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]) - 1), prepend=0) if texts else np.zeros(0, np.int64)
    out = np.full(len(h) + len(texts), END, dtype=np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(texts)), words)] = h
    return out, words + 1


class Memo:
    """What is known of words, by hash: columns with a slot for each value of a hash's highest bits.

    A later word takes an earlier one's slot.  Words that aren't in their slots are resolved
    together, stand behind the slots until the next call, and take their slots then.  Row 0 is for
    the mark before a text.
    """

    def __init__(self, kinds: dict[str, type], resolve: Callable[[np.ndarray], dict[str, np.ndarray]], bits: int | None = None):
        self.bits, self.resolve = bits or MEMO, resolve
        self.behind = 1 + (1 << self.bits)
        self.columns = {k: np.zeros(self.behind, dtype=kind) for k, kind in {"key": np.uint64, **kinds}.items()}
        self.pending = np.zeros(0, np.uint64)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64) + 1

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        if len(self.pending):
            slots = self._slots(self.pending)  # in order, as the words are
            last = np.flatnonzero(np.append(slots[1:] != slots[:-1], True))
            for c in self.columns.values():
                c[slots[last]] = c[self.behind + last]
        out = self._slots(hashes)
        miss = np.flatnonzero(self.columns["key"][out] != hashes)
        self.pending, inverse = np.unique(hashes[miss], return_inverse=True)
        if n := len(self.pending):
            if self.behind + n > len(self.columns["key"]):
                self.columns = {k: np.concatenate([c[: self.behind], np.zeros(n + n // 4, c.dtype)]) for k, c in self.columns.items()}
            for k, c in {"key": self.pending, **self.resolve(self.pending)}.items():
                self.columns[k][self.behind : self.behind + n] = c
            out[miss] = self.behind + inverse
        return out

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]


class Vocabulary:
    """Word hashes to numbers; -1 for words that training hasn't seen."""

    def __init__(self, shared: Shared, bits: int, starts: list[int]):
        self.shared, self.bits, self.starts = shared, bits, np.array(starts, dtype=np.int64)
        self.size = int(starts[-1])
        self._shards: dict[int, dict[str, np.ndarray]] = {}
        self._memo: Memo | None = None

    def shard(self, i: int) -> dict[str, np.ndarray]:
        if i not in self._shards:
            self._shards[i] = map_arrays(self.shared, f"words-{i:06d}")
        return self._shards[i]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of sorted hashes."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        shards = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(shards, prepend=-1))
        for a, z in zip(cuts, [*cuts[1:], len(hashes)]):
            i = int(shards[a])
            if self.starts[i] == self.starts[i + 1]:
                continue
            keys = self.shard(i)["key"]
            at = np.searchsorted(keys, hashes[a:z])
            out[a:z] = np.where(_found(keys, at, hashes[a:z]), at + self.starts[i], -1)
        return out

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Training occurrences by number; 0 for anything that is no number."""
        out = np.zeros(len(numbers), dtype=np.int64)
        known = np.flatnonzero((numbers >= 0) & (numbers < self.size))
        known = known[np.argsort(numbers[known])]
        shards = np.searchsorted(self.starts, numbers[known], side="right") - 1
        cuts = np.flatnonzero(np.diff(shards, prepend=-1))
        for a, z in zip(cuts, [*cuts[1:], len(known)]):
            of, i = known[a:z], shards[a]
            out[of] = widen(self.shard(int(i)), "count", numbers[of] - self.starts[i])
        return out

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if self._memo is None:
            self._memo = Memo({"number": np.int64}, lambda new: {"number": self.find(new)})
        rows = self._memo.rows(hashes)
        return self._memo["number"][rows]


def count_words(docs: DataFrame) -> DataFrame:
    """``(h, n)``: the occurrences of each word hash, partly added up; ``docs(doc_id, t)``."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            words, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return record_batch(schema, signed(words), n)

        for b in batches:
            texts = as_bytes(b.column(1))
            for a, z in steps(texts, STEP):
                held.append(hash_tokens(texts[a:z])[0])
                if sum(map(len, held)) > 2 * SHARD:
                    yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def build_vocabulary(docs: DataFrame, shared: Shared, hot: int) -> tuple[Vocabulary, int, list[int]]:
    """Writes the shards and the words that occur ``hot`` times or more (tokens / hot of them at most).

    Returns the vocabulary, the number of training tokens, and the shards' starts.
    """
    words = shared.table(count_words(docs), "counted")
    n, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = max(1, int(np.ceil(np.log2(max(1, n / SHARD)))))
    schema = pa.schema([("shard", pa.int64()), ("size", pa.int64()), ("at", pa.list_(pa.int64())), ("count", pa.list_(pa.int64()))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, keys, counts = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if last is not None:
                key, count = np.concatenate(keys).view(np.uint64), np.concatenate(counts)
                shared.write(f"words-{last:06d}", pack_arrays(key=key, **narrow("count", count)))
                at = np.flatnonzero(count >= hot)
                yield record_batch(schema, [last], [len(key)], [at], [count[at]])

        for b in batches:
            shard, key, count = (c.to_numpy() for c in b.columns)
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if shard[a] != last:
                    yield from flush()
                    last, keys, counts = int(shard[a]), [], []
                keys.append(key[a:z].astype(np.int64))
                counts.append(count[a:z].astype(np.int64))
        yield from flush()

    dealt = words.select(F.shiftrightunsigned("h", 64 - bits).alias("shard"), "h", "n")
    dealt = dealt.repartition(max(1, min(1 << bits, 4096)), "shard").sortWithinPartitions("shard", "h")
    sizes = np.zeros(1 << bits, dtype=np.int64)
    rows = sorted(shared.table(dealt.mapInArrow(write, "shard long, size long, at array<long>, count array<long>"), "sizes").collect(), key=lambda r: r.shard)
    for r in rows:
        sizes[r.shard] = r.size
    starts = [0, *np.cumsum(sizes).tolist()]
    common = [(starts[r.shard] + at, n) for r in rows for at, n in zip(r["at"], r["count"])]
    shared.write("common", pack_arrays(word=np.array([w for w, _ in common], np.int64), count=np.array([c for _, c in common], np.int64)))
    shared.remove("counted")
    return Vocabulary(shared, bits, starts), int(total), starts


# -- counting -------------------------------------------------------------------------------


_ENDLESS = 1 << 62


class Deal:
    """Which shard holds a context and a following word.

    Shards go by the highest bits of the context's hash.  A context whose words all occur ``hot``
    times or more may be very common: it is spread over as many shards as its rarest word fills.
    """

    def __init__(self, vocabulary: Vocabulary, shards: int, hot: int):
        self.vocabulary, self.shards, self.hot = vocabulary, shards, hot
        self.base = max(1, -(-vocabulary.size // shards))  # words of a shard of the last order
        self._common: tuple[np.ndarray, np.ndarray] | None = None

    def common(self) -> tuple[np.ndarray, np.ndarray]:
        """The words that occur ``hot`` times or more (at most tokens / hot of them), and how often."""
        if self._common is None:
            found = map_arrays(self.vocabulary.shared, "common")
            self._common = found["word"], found["count"]
        return self._common

    def context(self, grams: np.ndarray) -> np.ndarray:
        """A hash of all columns."""
        h = np.full(len(grams), grams.shape[1], dtype=np.uint64)
        for c in grams.T:
            h = mix(h, c.astype(np.uint64))
        return h

    def span(self) -> int:
        """How many shards n-grams are first dealt to together."""
        return -(-self.shards // WIDE) if self.shards > WIDE else 1

    def frequency(self, words: np.ndarray) -> np.ndarray:
        """How often common words occur, 0 for others; without bound for the mark before a text."""
        known, counts = self.common()
        out = np.where(words == self.vocabulary.size, _ENDLESS, 0)
        if len(known):
            at = np.minimum(np.searchsorted(known, words), len(known) - 1)
            hit = known[at] == words
            out[hit] = counts[at[hit]]
        return out

    def parts(self, least: np.ndarray) -> np.ndarray:
        """Over how many shards contexts are spread whose rarest words have these frequencies."""
        return np.maximum(1, np.where(least == _ENDLESS, 8, least // self.hot))

    def part(self, parts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Which of a context's parts holds the following word."""
        out = np.zeros(len(parts), dtype=np.int64)
        spread = np.flatnonzero(parts > 1)
        out[spread] = (mix(words[spread].astype(np.uint64), 7) % parts[spread].astype(np.uint64)).astype(np.int64)
        return out

    def shard(self, hashes: np.ndarray, part: np.ndarray | int) -> np.ndarray:
        spread = hashes + np.asarray(part).astype(np.uint64) * _SALT
        return ((spread >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)

    def of(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context hashes, and shards, of n-grams."""
        hashes = self.context(grams[:, :-1])
        least = self.frequency(grams[:, 0])
        for c in grams.T[1:-1]:
            some = np.flatnonzero(least)
            least[some] = np.minimum(least[some], self.frequency(c[some]))
        return hashes, self.shard(hashes, self.part(self.parts(least), grams[:, -1]))


def by_shard(shard: np.ndarray, shards: int) -> np.ndarray:
    """A stable order; sixteen bits sort in linear time."""
    return np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")


_DEALT = "shard int, grams binary, seen array<long>"
_DEALT_ARROW = pa.schema([("shard", pa.int32()), ("grams", pa.binary()), ("seen", pa.list_(pa.int64()))])


def _packs(grams: np.ndarray, counts: np.ndarray, shard: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """Sorted n-grams, packed by shard."""
    order = by_shard(shard, shards)
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for a, z in zip(cuts, [*cuts[1:], len(order)]):
        rows = order[a:z]
        yield record_batch(_DEALT_ARROW, [int(shard[rows[0]])], [pack_grams(grams[rows], counts[rows])], [None])


def _deals(deal: Deal, grams: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Distinct sorted n-grams, packed by shard; by ranges of shards if there are very many, so that packs don't get small."""
    shard = deal.of(grams)[1] if grams.shape[1] > 1 else grams[:, 0] // deal.base
    yield from _packs(grams, counts, shard // deal.span(), deal.shards)


def _by_shard_rows(dealt: DataFrame, partitions: int, finish: Callable[[int, Iterator[bytes]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``finish`` over each shard's packs, one shard after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((shard, pack) for b in batches for shard, pack in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for shard, group in groupby(rows, key=itemgetter(0)):
            yield from finish(shard, (pack for _, pack in group))

    packed = dealt.where("grams IS NOT NULL").select("shard", "grams")
    return packed.repartition(partitions, "shard").sortWithinPartitions("shard").mapInArrow(run, _DEALT)


def refined(dealt: DataFrame, deal: Deal, most: int = SHARD) -> DataFrame:
    """Packs of ranges of shards dealt anew, each to its shards; nothing to do if no range has two."""
    if deal.span() == 1:
        return dealt

    def split(_: int, packs: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            grams, counts = add_up(np.concatenate([g for g, _ in held]), np.concatenate([c for _, c in held]))
            shard = deal.of(grams)[1] if grams.shape[1] > 1 else grams[:, 0] // deal.base
            yield from _packs(grams, counts, shard, deal.shards)

        for pack in packs:
            held.append(unpack_grams(pack))
            size += len(held[-1][0])
            if size >= most:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return _by_shard_rows(dealt, -(-deal.shards // deal.span()), split)


def windows(numbers: np.ndarray, lengths: np.ndarray, order: int, before: int) -> np.ndarray:
    """The n-gram that ends at each token; ``before`` stands in front of every text."""
    out = np.full((len(numbers), order), before, dtype=np.int64, order="F")  # scoring goes by columns
    within = np.arange(len(numbers)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[:, -1] = numbers
    for k in range(1, order):
        has = np.flatnonzero(within >= k)
        out[has, order - 1 - k] = numbers[has - k]
    return out


def count_grams(docs: DataFrame, deal: Deal, order: int, most: int = SHARD) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            texts = as_bytes(b.column(1))
            for a, z in steps(texts, STEP):
                hashes, lengths = hash_tokens(texts[a:z])
                numbers = deal.vocabulary.numbers(hashes)
                held.append(windows(numbers, lengths, order, deal.vocabulary.size).astype(np.int32 if deal.vocabulary.size < 1 << 31 else np.int64, order="C"))
                size += len(numbers)
                if size >= most:
                    grams = np.concatenate(held)
                    held, size = [], 0
                    yield from _deals(deal, *add_up(grams, np.ones(len(grams), np.int64)))
        if held:
            grams = np.concatenate(held)
            held.clear()
            yield from _deals(deal, *add_up(grams, np.ones(len(grams), np.int64)))

    return docs.mapInArrow(run, _DEALT)


def write_order(dealt: DataFrame, deal: Deal, shared: Shared, order: int, partitions: int) -> DataFrame:
    """Writes the shards of an order; hands on the n-grams without their first word, dealt again.

    Rows with ``seen`` instead of n-grams tell each shard's counts of counts.
    """

    def finish(shard: int, packed: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        found = [unpack_grams(p) for p in packed]
        grams, counts = np.concatenate([g for g, _ in found]), np.concatenate([c for _, c in found])
        del found
        if order == 1:
            grams, counts = add_up(grams, counts)
        else:
            hashes = deal.context(grams[:, :-1])
            by, new = sorted_rows([hashes, grams[:, -1]])
            first = np.flatnonzero(new)
            counts = np.add.reduceat(counts[by], first)
            grams, hashes = grams[by[first]], hashes[by[first]]
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            lengths = np.diff(np.append(first, len(hashes)))
            # A context that one word alone follows needs no totals.
            alone, many = first[lengths == 1], first[lengths > 1]
            inside = np.repeat(lengths > 1, lengths)
            shift = np.uint64(deal.vocabulary.size.bit_length())
            owner = np.repeat(np.arange(len(many), dtype=np.uint64), lengths[lengths > 1])
            arrays = {"lone": hashes[alone], "lone_word": grams[alone, -1].astype(np.uint32 if shift <= 32 else np.uint64), **narrow("lone_count", counts[alone])}
            arrays |= {"key": hashes[many], **narrow("types", lengths[lengths > 1]), "pair": owner << shift | grams[inside, -1].astype(np.uint64), **narrow("count", counts[inside])}
            for name, x in (("total", counts), ("once", counts == 1), ("twice", counts == 2)):
                arrays |= narrow(name, np.add.reduceat(x.astype(np.int64), first)[lengths > 1])
            shared.write(f"order{order}-{shard:06d}", pack_arrays(**arrays))
            del arrays, hashes, by, new, first, inside, owner
        if order == 1:
            dense = np.zeros(deal.base, dtype=np.int64)
            dense[grams[:, 0] - shard * deal.base] = counts
            shared.write(f"order1-{shard:06d}", pack_arrays(**narrow("count", dense)))
        seen = np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()
        yield record_batch(_DEALT_ARROW, [shard], [None], [[*seen, int(counts.sum())]])
        if order > 1:
            yield from _deals(deal, *add_up(grams[:, 1:], np.ones(len(grams), np.int64)))

    return _by_shard_rows(refined(dealt, deal), partitions, finish)


def discounts(seen: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's discounts for counts of one, two and more, from the counts of counts."""
    n1, n2, n3, n4 = (float(x) for x in seen)
    if not n1 or not n2:
        return 0.5, 0.75, 0.9  # too few n-grams to tell
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


def train(docs: DataFrame, shared: Shared, order: int = ORDER, shard: int = SHARD) -> dict:
    """Learns from ``docs(doc_id, t)`` and writes the model; returns its description."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    hot = max(1000, shard // 4)
    vocabulary, tokens, starts = build_vocabulary(docs, shared, hot)
    shards = max(1, -(-tokens // shard))
    deal = Deal(vocabulary, shards, hot)
    about = {"root": shared.root, "order": order, "tokens": tokens, "vocabulary": vocabulary.size, "bits": vocabulary.bits, "starts": starts, "shards": shards, "hot": deal.hot}
    if tokens:
        partitions = max(1, min(shards, 8192))
        dealt = count_grams(docs, deal, order, shard)
        for k in range(order, 0, -1):
            dealt = shared.table(write_order(dealt, deal, shared, k, partitions), f"dealt-{k - 1}")
            if k < order:
                shared.remove(f"dealt-{k}")
            sums = list(dealt.agg(*[F.sum(F.col("seen")[i]) for i in range(5)]).first())
            about[f"discounts{k}"] = discounts(sums[:4])
            about[f"sum{k}"] = sums[4]
            about[f"once{k}"] = sums[:2] + [sum(sums[:4])]
        shared.remove("dealt-0")
        about["types"] = vocabulary.size
    return about


# -- scoring --------------------------------------------------------------------------------


class Model:
    """The arrays of a model, opened from the shared folder as they are needed."""

    def __init__(self, about: dict):
        self.about = about
        self.shared = Shared(about["root"])
        self.order = about["order"]
        self.vocabulary = Vocabulary(self.shared, about["bits"], about["starts"])
        self.deal = Deal(self.vocabulary, about["shards"], about["hot"])
        self._files: dict[tuple[int, int], dict[str, np.ndarray] | None] = {}
        self.base = self.deal.base
        self.unit = about["tokens"] + 0.5 * (self.vocabulary.size + 1)
        f, i = np.float64, np.int64
        self.words = Memo({"number": i, "known": np.bool_, "base": f, "lowest": f, "common": i, "hash": np.uint64, "parts": i, "total": f, "left": f, "shard": i, "at": i}, self.resolve)
        start = self._context_of(np.array([self.vocabulary.size], dtype=i)) if about["tokens"] else {}
        for name, x in ({"number": self.vocabulary.size} | start).items():
            self.words[name][:1] = x

    def file(self, order: int, shard: int) -> dict[str, np.ndarray] | None:
        if (order, shard) not in self._files:
            if len(self._files) >= MAPPED:
                self._files.clear()
            name = f"order{order}-{shard:06d}"
            self._files[order, shard] = map_arrays(self.shared, name) if self.shared.exists(name) else None
        return self._files[order, shard]

    def _groups(self, order: int, shard: np.ndarray) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
        """Each shard's arrays, and the rows that it concerns."""
        by = by_shard(shard, self.deal.shards)
        cuts = np.flatnonzero(np.diff(shard[by], prepend=-1))
        for a, z in zip(cuts, [*cuts[1:], len(by)]):
            if (f := self.file(order, int(shard[by[a]]))) is not None:
                yield f, by[a:z]

    # -- what is remembered of a word

    def resolve(self, hashes: np.ndarray) -> dict[str, np.ndarray]:
        numbers = self.vocabulary.find(hashes)
        c = self.vocabulary.counts(numbers)
        out = {"number": numbers, "known": c > 0, "base": np.log10((c + 0.5) / self.unit)}
        return out | ({"lowest": self.unigram(numbers)} | self._context_of(numbers) if self.about["tokens"] else {})

    def _context_of(self, numbers: np.ndarray) -> dict[str, np.ndarray]:
        """The word as a context of its own."""
        common = self.deal.frequency(numbers)
        hashes, parts = self.deal.context(numbers[:, None]), self.deal.parts(common)
        found = self.contexts(2, hashes, parts)
        return {"common": common, "hash": hashes, "parts": parts, **dict(zip(("total", "left", "shard", "at"), found))}

    def unigram(self, words: np.ndarray) -> np.ndarray:
        """Interpolated with the uniform distribution over the vocabulary and one unknown word."""
        about = self.about
        d1, d2, d3 = about["discounts1"]
        n = np.zeros(len(words), dtype=np.int64)
        known = np.flatnonzero(words >= 0)
        for f, rows in self._groups(1, words[known] // self.base):
            n[known[rows]] = widen(f, "count", words[known[rows]] % self.base)
        once, twice, _ = about["once1"]
        mass = d1 * once + d2 * twice + d3 * (about["types"] - once - twice)
        taken = np.array([0, d1, d2, d3])[np.minimum(n, 3)]
        total = about["sum1"]
        return (n - taken) / total + mass / total / (about["types"] + 1)

    # -- lookups

    def place(self, order: int, hashes: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """int64[5, n] for contexts: their place in the shard (-1: none); count, words that follow once, twice, and all of them.

        Contexts that one word alone follows are placed behind the others.
        """
        out = np.zeros((5, len(hashes)), dtype=np.int64)
        out[0] = -1
        for f, rows in self._groups(order, shard):
            h = hashes[rows]
            at = np.searchsorted(f["key"], h)
            found = _found(f["key"], at, h)
            mine, at = rows[found], at[found]
            for k, x in enumerate((at, *(widen(f, name, at) for name in ("total", "once", "twice", "types")))):
                out[k, mine] = x
            mine, h = rows[~found], h[~found]
            at = np.searchsorted(f["lone"], h)
            found = _found(f["lone"], at, h)
            mine, at = mine[found], at[found]
            n = widen(f, "lone_count", at)
            for k, x in enumerate((at + len(f["key"]), n, n == 1, n == 2, 1)):
                out[k, mine] = x
        return out

    def contexts(self, order: int, hashes: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Total and discounted mass of contexts; their shard and place, of no use for contexts that are spread."""
        shard = self.deal.shard(hashes, 0)
        at, *kinds = self.place(order, hashes, shard)
        spread = np.flatnonzero(parts > 1)
        if len(spread):
            _, first, inverse = np.unique(hashes[spread], return_index=True, return_inverse=True)
            for x, y in zip(kinds, self._spread(order, hashes[spread[first]], parts[spread[first]])):
                x[spread] = y[inverse]
        d1, d2, d3 = self.about[f"discounts{order}"]
        total, once, twice, types = kinds
        return total.astype(np.float64), d1 * once + d2 * twice + d3 * (types - once - twice), shard, at

    def _spread(self, order: int, hashes: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Count, words that follow once, twice, and all of them, added up over the shards of each context."""
        out = np.zeros((4, len(hashes)), dtype=np.int64)
        of = np.repeat(np.arange(len(hashes)), parts)
        part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        shard = self.deal.shard(hashes[of], part)
        # Two parts of a context may have come to one shard.
        order_ = np.lexsort((shard, of))
        new = np.ones(len(of), dtype=bool)
        new[1:] = (np.diff(of[order_]) != 0) | (np.diff(shard[order_]) != 0)
        of, shard = of[order_[new]], shard[order_[new]]
        for x, y in zip(out, self.place(order, hashes[of], shard)[1:]):
            np.add.at(x, of, y)
        return out

    def counts(self, order: int, shard: np.ndarray, at: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The counts of words after the contexts at these places of shards; 0 where they don't follow."""
        out = np.zeros(len(words), dtype=np.int64)
        real = np.flatnonzero((at >= 0) & (words >= 0))
        shift = np.uint64(self.vocabulary.size.bit_length())
        for f, rows in self._groups(order, shard[real]):
            rows = real[rows]
            lone = at[rows] - len(f["key"])
            mine, i = rows[lone >= 0], lone[lone >= 0]
            hit = f["lone_word"][i] == words[mine]
            out[mine[hit]] = widen(f, "lone_count", i[hit])
            mine = rows[lone < 0]
            wanted = at[mine].astype(np.uint64) << shift | words[mine].astype(np.uint64)
            i = np.searchsorted(f["pair"], wanted)
            hit = _found(f["pair"], i, wanted)
            out[mine[hit]] = widen(f, "count", i[hit])
        return out

    # -- probabilities

    def score(self, hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token of some texts: whether training has it, its base log10, and the model's probability."""
        word = self.words.rows(hashes)
        known, base, p = (self.words[k][word] for k in ("known", "base", "lowest"))
        if not self.about["tokens"]:
            return known, base, np.ones(len(word))
        number = self.words["number"]
        grams = windows(word, lengths, self.order, 0)  # rows of the memo, the mark before a text being row 0
        last = number[word]
        first = np.zeros(len(word), dtype=bool)
        first[np.cumsum(lengths) - lengths] = True
        seen = np.ones(len(word), dtype=bool)  # whether the context's own n-gram was counted; else no longer one was either
        for k in range(2, self.order + 1):
            rows = np.flatnonzero(seen)
            if k == 2:
                before = grams[:, -2]
                rows = np.argsort(self.words["hash"][before])  # lookups in order are several times faster
                before = before[rows]
                hash_, parts, total, left, shard, at = (self.words[c][before] for c in ("hash", "parts", "total", "left", "shard", "at"))
            else:
                context = grams[rows, -k:-1]
                hash_ = self.deal.context(number[context])
                order = np.argsort(hash_)
                rows, hash_, context = rows[order], hash_[order], context[order]
                parts = self.deal.parts(np.minimum.reduce([self.words["common"][c] for c in context.T]))
                total, left, shard, at = self.contexts(k, hash_, parts)
            word_ = last[rows]
            spread = np.flatnonzero(parts > 1)
            if len(spread):
                shard[spread] = self.deal.shard(hash_[spread], self.deal.part(parts[spread], word_[spread]))
                at[spread] = self.place(k, hash_[spread], shard[spread])[0]
            n = self.counts(k, shard, at, word_)
            d = np.array([0.0, *self.about[f"discounts{k}"]])
            has = np.flatnonzero(total > 0)
            mine = rows[has]
            p[mine] = (n[has] - d[np.minimum(n[has], 3)] + left[has] * p[mine]) / total[has]
            if k < self.order:
                counted = np.zeros(len(word) + 1, dtype=bool)
                counted[rows + 1] = n > 0
                seen = counted[:-1] | first
        return known, base, p


def _found(keys: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether searchsorted has met the key itself."""
    if not len(keys):
        return np.zeros(len(at), dtype=bool)
    return keys[np.minimum(at, len(keys) - 1)] == wanted


@lru_cache(maxsize=2)
def _open(about: str) -> Model:
    return Model(json.loads(about))


def score(docs: DataFrame, about: dict) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` for each row of ``docs(doc_id, t)``.

    Both scores are log10 probabilities of the whole text and its end.  Without training tokens
    the base is 0 (one possible token, the unknown one) and so is the score.
    """
    text = json.dumps(about)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _open(text)
        for b in batches:
            texts = as_bytes(b.column(1))
            for a, z in steps(texts, STEP):
                hashes, lengths = hash_tokens(texts[a:z])
                known, base, p = model.score(hashes, lengths)
                sums = [np.add.reduceat(x, np.cumsum(lengths) - lengths) for x in (known.astype(np.int64), base, np.log10(p))]
                yield record_batch(schema, b.column(0).slice(a, z - a), lengths, sums[0], np.full(z - a, about["tokens"]), sums[1], sums[2])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))


def lm_scores(docs: DataFrame, held_out, spark: SparkSession | None = None, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Learns from the rows where ``held_out`` is false and scores all rows, with the flag.

    Null and empty texts are the end alone, one token.  A null id counts as training.  Repeated
    rows count and are scored each.  An empty table gives an empty table.  Other columns are ignored.
    """
    shared = Shared.create(spark or docs.sparkSession, "lm")
    about = train(prepared(docs.where(~held_out), id_col, text_col), shared, order)
    return score(prepared(docs, id_col, text_col), about)
