"""BPE encoding and decoding, equal to the tokenizers library for texts of any length.

A text over LONG characters is encoded as a tree: it is halved, wherever that is, until the parts
are short; all parts are encoded in one batch, side by side, and then joined pairwise.  Around a
join a window is encoded anew that grows on both sides until they agree: until it begins and ends
at a place that no token can cross (a space between two characters that aren't white space), and
the halves' own tokens up to there are those that the window's parts have by themselves.

A stretch over a leaf without such a place ("unsplit") is taken out first, split into the
tokenizer's own pre-tokens, and a pre-token longer than a leaf is a tree itself.  Joining there uses
that a sequence of tokens is the encoding of its bytes if and only if every two neighbours are the
encoding of theirs.  A window of tokens around the join is encoded anew.  If the result begins with
the window's first token and ends with its last one, then every pair of neighbours of the spliced
sequence has been seen in a true encoding, so the splice is exact; otherwise the window doubles on
the side that differs.

Parts in Latin-1 without long words go to tiktoken over the same merges as ranks, which gives the
same tokens in a quarter of the time; the others go to the library.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm.common import record_batch

#: Parameters: texts over LONG characters and pre-tokens over LEAF bytes are encoded as trees; stretches over LEAF are unsplit.
#: FIRST_WINDOW tokens, or 16 times as many characters, stand on each side of a join at first.
#: Words over RANKED_WORD characters aren't left to the ranked encoder, whose time grows with their square.
LONG, LEAF, FIRST_WINDOW, STEP_CHARS, RANKED_WORD = 1 << 14, 1 << 12, 4, 1 << 19, 400
#: Fixed value: how byte-level pre-tokenizers split text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACES = re.compile(rf"\s{{{RANKED_WORD},}}")
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Bpe:
    """A tokenizer file (byte-level BPE) with exact encoding of long texts."""

    def __init__(self, path: str, long: int = LONG, leaf: int = LEAF):
        self.long, self.leaf, self.joins = long, leaf, 0
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = Tokenizer(self.library.model)  # neither pre-tokens nor special tokens
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.specials = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = re.compile("|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        alphabet = _byte_alphabet()
        self.tokens = [self.library.id_to_token(i) or "" for i in range(size)]
        self.bytes = [t.encode() if t in self.specials else bytes(alphabet[c] for c in t) for t in self.tokens]
        self.decimal = [str(i) for i in range(size)]
        self.ranked = self._ranked(path)

    def _ranked(self, path: str) -> tiktoken.Encoding | None:
        """The same merges as ranks, several times faster; None if the file says more than that."""
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, split = said["model"], said["pre_tokenizer"] or {}
        plain = not said["normalizer"] and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        if not plain or model.get("type") != "BPE" or any(model.get(k) for k in options):
            return None
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        made = [model["vocab"].get("".join(m)) for m in pairs]
        if None in made or any(a >= b for a, b in zip(made, made[1:])):
            return None
        ranks = {self.bytes[i]: i for t, i in model["vocab"].items() if t not in self.specials}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        listed = {i: tuple(self.bytes[model["vocab"][x]] for x in m) for i, m in zip(made, pairs)}
        if any(_last_pair(t, i, ranks) != listed.get(i, ()) for t, i in ranks.items() if len(t) > 1):
            return None
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _suits_ranked(self, text: str) -> bool:
        """Texts in Latin-1, whose characters have the same classes in every version of Unicode, without special tokens."""
        if self.ranked is None or any(s in text for s in self.specials):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return max(map(len, text.split()), default=0) <= RANKED_WORD and not _SPACES.search(text)

    # -- encoding

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [ids for ids, _ in self.encode_counted(texts)]

    def encode_counted(self, texts: list[str]) -> list[tuple[list[int], int]]:
        """The ids of each text, and how many joins its trees took."""
        plain = [i for i, t in enumerate(texts) if len(t) <= self.long and not self._has_unsplit(t)]
        out: list[tuple[list[int], int] | None] = [None] * len(texts)
        for i, ids in zip(plain, self._short([texts[i] for i in plain])):
            out[i] = ids, 0
        for i, t in enumerate(texts):
            if out[i] is None:
                before = self.joins
                out[i] = self.encode_long(t), self.joins - before
        return out

    def _short(self, texts: list[str], parallel: bool = False) -> list[list[int]]:
        """Texts without unsplit stretches, by the ranked encoder where that suits, else by the library."""
        out = [self.ranked.encode_ordinary(t) if self._suits_ranked(t) else None for t in texts]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._library([texts[i] for i in rest], parallel)):
            out[i] = ids
        return out

    def _library(self, texts: list[str], parallel: bool = False) -> Iterator[list[int]]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if parallel else "false"
        start = size = 0
        for i in range(len(texts) + 1):
            if i == len(texts) or size and size + len(texts[i]) > STEP_CHARS:
                for e in self.library.encode_batch_fast(texts[start:i], add_special_tokens=False):
                    yield e.ids
                start, size = i, 0
            if i < len(texts):
                size += len(texts[i])

    def _cuts(self, text: str) -> Iterator[int]:
        """Where no token can cross, and the end."""
        yield from (m.start() for m in _CUT.finditer(text))
        yield len(text)

    def _has_unsplit(self, text: str) -> bool:
        """Whether a stretch without cuts is longer than a leaf."""
        at = 0
        if len(text) > self.leaf:
            for end in self._cuts(text):
                if end - at > self.leaf:
                    return True
                at = end
        return False

    def encode_long(self, text: str) -> list[int]:
        ids: list[int] = []
        at = last = 0
        for end in self._cuts(text):
            if end - last > self.leaf:
                ids += self.tree_of_text(text[at:last]) + self.encode_unsplit(text[last:end])
                at = end
            last = end
        return ids + self.tree_of_text(text[at:])

    def tree_of_text(self, text: str) -> list[int]:
        """A text without unsplit stretches: halves of halves are encoded side by side, then joined."""
        n = 1 << (-(-2 * len(text) // self.long) - 1).bit_length() if len(text) > self.long else 1
        cuts = [len(text) * i // n for i in range(n + 1)]
        level = list(zip(cuts, self._short([text[a:z] for a, z in zip(cuts, cuts[1:])], parallel=True)))
        ends = cuts[1:]
        while len(level) > 1:
            level = [(a, self.join_texts(text[a:middle], left, text[middle:end], right)) for (a, left), (middle, right), end in zip(level[::2], level[1::2], ends[1::2])]
            ends = ends[1::2]
        return level[0][1]

    def join_texts(self, a: str, left: list[int], b: str, right: list[int]) -> list[int]:
        """The encoding of ``a + b`` from those of both."""
        self.joins += 1
        size = 16 * FIRST_WINDOW
        while size < 2 * max(len(a), len(b)):
            begin = max((m.start() for m in _CUT.finditer(a, max(0, len(a) - size))), default=None)
            end = next((m.start() for m in _CUT.finditer(b, 0, min(len(b), size))), None)
            if begin is not None and end is not None:
                head, tail, both = self._short([a[begin:], b[:end], a[begin:] + b[:end]])
                if left[len(left) - len(head) :] == head and right[: len(tail)] == tail:
                    return left[: len(left) - len(head)] + both + right[len(tail) :]
            size *= 2
        return self._short([a + b])[0]

    def encode_unsplit(self, text: str) -> list[int]:
        """A stretch that can't be cut beforehand: special tokens, then pre-tokens, then trees."""
        ids: list[int] = []
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            ids += self._pretokens(text[at : m.start()])
            ids.append(self.specials[m[0]])
            at = m.end()
        return ids + self._pretokens(text[at:])

    def _pretokens(self, text: str) -> list[int]:
        ids: list[int] = []
        words: list[str] = []

        def flush() -> None:
            for found in self._raw(words) if words else ():
                ids.extend(found)
            words.clear()

        for word, _ in self.library.pre_tokenizer.pre_tokenize_str(text) if text else ():
            if len(word) <= self.leaf:
                words.append(word)
                if len(words) >= 4096:
                    flush()
            else:
                flush()
                ids += self.tree(word)
        flush()
        return ids

    def _raw(self, words: list[str], parallel: bool = False) -> list[list[int]]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if parallel else "false"
        return [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def tree(self, word: str) -> list[int]:
        """One pre-token, in the byte alphabet; all leaves are encoded in one batch, then joined pairwise."""
        if len(word) <= self.leaf:
            return self._raw([word])[0]
        n = 1 << (-(-len(word) // self.leaf) - 1).bit_length()
        cuts = [len(word) * i // n for i in range(n + 1)]
        level = self._raw([word[a:z] for a, z in zip(cuts, cuts[1:])], parallel=True)
        while len(level) > 1:
            level = [self.join(a, b) for a, b in zip(level[::2], level[1::2])]
        return level[0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both, each being an encoding."""
        self.joins += 1
        i = j = FIRST_WINDOW
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            head, tail = left[len(left) - i :], right[:j]
            found = self._raw(["".join(self.tokens[k] for k in (*head, *tail))])[0]
            fits_left = i == len(left) or found[0] == head[0]
            fits_right = j == len(right) or found[-1] == tail[-1]
            if fits_left and fits_right:
                return left[: len(left) - i] + found + right[j:]
            i, j = i if fits_left else 2 * i, j if fits_right else 2 * j

    # -- decoding

    def decode(self, ids: list[int]) -> str:
        """As the library decodes, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _last_pair(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, ...] | None:
    """What merging by ranks below ``rank`` leaves of a token's bytes.

    Merging by ranks joins the token only from these parts, in any text: until then no merge has
    crossed its ends.  So ranks stand for the listed merges if these parts are the listed pair.
    """
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        least, at = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if least >= rank:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return tuple(parts)


def _byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """One for each worker process and file."""
    return Bpe(path)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# -- the operators --------------------------------------------------------------------------


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > STEP_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` for each row: the token ids of the whole text.

    Null and empty texts have no ids.  Repeated rows give a row each, an empty table an empty one.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for a, z in _chunks(texts):
                yield record_batch(schema, b.column(0).slice(a, z - a), bpe.encode_batch(texts[a:z]))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` for each row of ids; null ids give the empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            for a in range(0, b.num_rows, 64):
                ids = b.column(1).slice(a, 64).to_pylist()
                yield record_batch(schema, b.column(0).slice(a, 64), [bpe.decode(x or []) for x in ids])

    return encoded.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, joins)``: encodes and decodes in one pass.

    ``joins`` counts the joins of trees, 0 for short texts.  Ids leave the worker only if ``ids`` asks
    for them as a further column.  Null and empty texts have no tokens and the digests of nothing.
    Repeated rows give a row each, an empty table an empty one; other columns are ignored.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("joins", pa.int64())]
    layout = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, joins long"
    if ids:
        fields, layout = [*fields, ("ids", pa.list_(pa.int32()))], layout + ", ids array<int>"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        sha = hashlib.sha256
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for a, z in _chunks(texts):
                counted = bpe.encode_counted(texts[a:z])
                found = [x for x, _ in counted]
                yield record_batch(
                    schema,
                    b.column(0).slice(a, z - a),
                    [len(x) for x in found],
                    [sha(",".join(map(bpe.decimal.__getitem__, x)).encode()).hexdigest() for x in found],
                    [sha(bpe.decode(x).encode()).hexdigest() for x in found],
                    [n for _, n in counted],
                    *([found] if ids else []),
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, layout)
