"""Anchors: positions picked from the content alone, so that every window of a given size
that occurs twice holds the same anchor at the same place in both occurrences.

An anchor is the unit (byte or word) where the gram of ``gram`` units with the least hash of
a window starts; every window of ``window`` units has one, and about two in
``window - gram + 2`` units are anchors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PLACE = np.uint64((1 << 24) - 1)
STRETCH = 1 << 23
LONG_WORD = 256


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


BYTE_CODES = mix(mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)))


KEPT = 1 << 21
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n, modulo 2^64; those for usual sizes are kept."""
    size = max(KEPT, n + 1)
    if not _powers or len(_powers[0][0]) < size:
        pair = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
        for p in pair:
            p[0] = 1
            np.cumprod(p, out=p)
        if size > KEPT:  # for one long text
            return pair
        _powers[0] = pair
    return _powers[0]


class Hashes:
    """Hashes of any stretches of a sequence of 64-bit codes, from prefix sums modulo 2^64."""

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        self.power, inverse = powers(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * inverse[:n], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        """Of the stretches [start, end); equal for equal content and length."""
        length = (end - start).astype(np.uint64)
        return mix((self.sums[end] - self.sums[start]) * self.power[start] + length * np.uint64(0xE7037ED1A0B428DB))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, last byte + 1, offsets by word) of the runs of non-blank bytes."""
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    inside = ~blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_CODES[data], offsets


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code per word.  Words over ``LONG_WORD`` bytes are digested one by one: modulo 2^64
    there are words of about a thousand letters whose polynomials are equal."""
    from xxhash import xxh3_64_intdigest

    starts, ends, bounds = words_of(data, offsets)
    codes = Hashes(BYTE_CODES[data]).of(starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        codes[i] = xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), int(BASE))
    return codes, bounds


@dataclass
class Anchors:
    """row and pos (unit in the text) of each anchor; at is its place in the hashed codes,
    which hold the units from at - before up to at + after of its text around it."""

    row: np.ndarray
    pos: np.ndarray
    at: np.ndarray
    before: np.ndarray
    after: np.ndarray
    hashes: Hashes


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def owners(hashes: Hashes, n: int, window: int, gram: int) -> np.ndarray | None:
    """The anchor of each window of one text of ``n`` units; None for texts of many millions."""
    if n > STRETCH:
        return None
    places = np.arange(n - gram + 1)
    keys = (hashes.of(places, places + gram) & ~PLACE) | places.astype(np.uint64)
    return (_least(keys, window - gram + 1) & PLACE).astype(np.int64)


def find_anchors(codes: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> Iterator[Anchors]:
    """Anchors of the texts whose units are codes[bounds[i]:bounds[i + 1]]."""
    if len(codes) > STRETCH + 4 * window and len(bounds) == 2:  # one long text, in overlapping stretches
        for core in range(0, len(codes), STRETCH):
            lo, hi = max(0, core - 2 * window), min(len(codes), core + STRETCH + 2 * window)
            for a in find_anchors(codes[lo:hi], np.array([0, hi - lo]), window, gram):
                own = (a.pos + lo >= core) & (a.pos + lo < core + STRETCH)
                yield Anchors(a.row[own], a.pos[own] + lo, a.at[own], a.before[own], a.after[own], a.hashes)
        return
    n = len(codes)
    if n < window:
        return
    hashes = Hashes(codes)
    places = np.arange(n - gram + 1)
    keys = (hashes.of(places, places + gram) & ~PLACE) | places.astype(np.uint64)
    least = _least(keys, window - gram + 1)
    room = np.repeat(bounds[1:], np.diff(bounds))[: len(least)] - places[: len(least)]
    chosen = np.zeros(n, bool)
    chosen[(least[room >= window] & PLACE).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    row = np.searchsorted(bounds, at, "right") - 1
    yield Anchors(row, at - bounds[row], at, at - bounds[row], bounds[row + 1] - at, hashes)
