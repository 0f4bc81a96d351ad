"""Fingerprints as bit planes: many Hamming distances at once.

Plane b holds bit b of all fingerprints, 64 to a word.  A *cell* is one query against one word of 64
fingerprints; carry-save counters add up the differing bits of all cells, two planes at a time.  The
counters start as far below overflow as the radius allows, so a count that passes the radius
overflows, for good; a cell is abandoned once all its 64 have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """uint64[n, w] -> uint64[64 * w, ceil(n / 64)]."""
    padded = np.zeros((-(-len(fps) // 64) * 64, fps.shape[1]), dtype=np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(queries: np.ndarray, planes: np.ndarray, radius: int, passed: np.ndarray, every: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells with a fingerprint within the radius: query, word of the planes, and match bits.

    ``passed`` (uint64[queries, words]) marks what needn't be compared.
    """
    rows, words = np.nonzero(passed != FULL)
    over = passed[rows, words]
    bits = np.unpackbits(np.ascontiguousarray(queries).view(np.uint8), axis=1, bitorder="little")
    masks = np.where(np.ascontiguousarray(bits.T), FULL, np.uint64(0))
    n_counters = max(1, int(radius).bit_length())
    start = (1 << n_counters) - 1 - radius
    counters = [np.full(len(rows), FULL if start >> k & 1 else 0, dtype=np.uint64) for k in range(n_counters)]
    for b in range(0, len(planes), 2):
        d = planes[b][words] ^ masks[b][rows]
        e = planes[b + 1][words] ^ masks[b + 1][rows]
        half = d ^ e
        carry = (d & e) | (half & counters[0])
        counters[0] ^= half
        for c in counters[1:]:
            up = c & carry
            c ^= carry
            carry = up
        over |= carry
        if b % every == every - 2:
            alive = over != FULL
            if not alive.any():
                return rows[:0], words[:0], over[:0]
            if np.count_nonzero(alive) < 0.8 * len(alive):
                rows, words, over = rows[alive], words[alive], over[alive]
                counters = [c[alive] for c in counters]
    alive = over != FULL
    return rows[alive], words[alive], ~over[alive]


def matches(fps: np.ndarray, radius: int, tile: int = 256):
    """A function of the rows that ask: yields each with the rows that are within the radius of it.

    Of two rows that both ask, the earlier one finds the pair.
    """
    n, planes = len(fps), bit_planes(fps)
    lanes = planes.shape[1]
    padding = np.zeros(64 * lanes, dtype=bool)
    padding[n:] = True
    upto = np.array([(2 << k) - 1 if k < 63 else 0xFFFFFFFFFFFFFFFF for k in range(64)], dtype=np.uint64)

    def find(asks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        asking = np.zeros(64 * lanes, dtype=bool)
        asking[asks] = True
        asking, outside = (np.packbits(x, bitorder="little").view(np.uint64) for x in (asking, padding))
        for at in range(0, len(asks), tile):
            mine = asks[at : at + tile]
            word = np.arange(lanes)[None, :]
            before = np.where(word < (mine // 64)[:, None], FULL, np.uint64(0))
            before[np.arange(len(mine)), mine // 64] = upto[mine % 64]
            rows, words, found = within(fps[mine], planes, radius, before & asking | outside)
            cuts = np.flatnonzero(np.diff(rows, prepend=-1))
            for a, z in zip(cuts, [*cuts[1:], len(rows)]):
                hit = np.unpackbits(found[a:z].view(np.uint8), bitorder="little").reshape(-1, 64)
                cell, bit = np.nonzero(hit)
                yield int(mine[rows[a]]), words[a:z][cell] * 64 + bit

    return find
