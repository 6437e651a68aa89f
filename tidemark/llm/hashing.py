"""Hashed text features without a Python object per word: whole batches of texts as one byte array.

A word's hash is a polynomial over its bytes, taken as a difference of running sums, so that any number of words costs a
few passes over the bytes. N-grams are mixed from word hashes. Texts longer than twice `PIECE` bytes are looked at in pieces, cut at white
space, with the last words of a piece in front of the next (`joined_words`), so the cuts change no feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes looked at in one go, unless a single text has more; then the text is cut at the next white space.
PIECE = 1 << 20


class Tables:
    """Byte classes and powers, made once per task."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.values = rng.integers(1, 2**63, 256, dtype=np.uint64)
        self.lowered = self.values.copy()
        self.lowered[65:91] = self.values[97:123]
        kinds = np.full(256, 1, np.uint8)
        kinds[65:91], kinds[48:58] = 2, 3
        for punct in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)):
            kinds[punct] = punct
        self.shapes = self.values[kinds]
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.blank = np.ones(256, bool)  # everything but letters; bytes of longer characters count as letters
        self.blank[65:91] = self.blank[97:123] = self.blank[128:] = False
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers) < n:
            inverse = np.uint64(pow(int(self.base), -1, 2**64))
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.base)]))
            self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]))
        return self.powers, self.inverses


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the limits of its rows; NULL is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    limits = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[limits[0] : limits[-1]], limits - limits[0]


def runs(column: pa.Array, space: np.ndarray, size: int = PIECE) -> Iterator[tuple[np.ndarray, list]]:
    """(rows, pieces): rows in order, about `size` bytes at a time, each piece (bytes, limits of the rows in it).

    Rows come with one piece; a text of over twice that size comes alone, in pieces cut after white space.
    """
    data, limits = raw_texts(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(limits, limits[first] + size, side="right")) - 1)
        start, end = int(limits[first]), int(limits[last])
        cuts = []
        while end - start > 2 * size:
            cut = start + size
            while cut < end and not space[data[cut - 1]]:
                ahead = np.flatnonzero(space[data[cut : min(end, cut + size)]])
                cut = cut + int(ahead[0]) + 1 if len(ahead) else min(end, cut + size)
            cuts.append((data[start:cut], np.array([0, cut - start])))
            start = cut
        if not cuts or start < end:
            cuts.append((data[start:end], np.array([0, end - start]) if cuts else limits[first : last + 1] - start))
        yield np.arange(first, last), cuts
        first = last


class Words:
    """The words of some texts: where they start and end, and which text (of those given) each is in.

    `between` tells the bytes that stand between words, white space if not given.
    """

    def __init__(self, data: np.ndarray, limits: np.ndarray, tables: Tables, between: np.ndarray | None = None):
        between = tables.space if between is None else between
        self.tables, self.data, self.n_texts = tables, data, len(limits) - 1
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~between[data]
        first = np.zeros(len(data) + 2, bool)  # the first byte of a text starts a word whatever stands before it
        first[limits[:-1] + 1] = True
        starts = inside & (first | ~np.concatenate([[False], inside[:-1]]))
        ends = inside[:-1] & ~(inside[1:] & ~first[1:])
        self.starts = np.flatnonzero(starts) - 1
        self.ends = np.flatnonzero(ends)
        self.texts = np.searchsorted(limits, self.starts, side="right") - 1

    def sums(self, values: np.ndarray) -> np.ndarray:
        powers, _ = self.tables.upto(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(values[self.data] * powers[: len(self.data)], out=out[1:])
        return out

    def span_hash(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, inverses = self.tables.upto(len(self.data) + 1)
        return mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))

    def pairs(self, h: np.ndarray, gap: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of (word, word `gap` further on) inside a text, and the text of each."""
        if len(h) <= gap:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        same = self.texts[gap:] == self.texts[:-gap]
        joint = mixed(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] + np.uint64(salt))
        return joint[same], self.texts[gap:][same]


def joined_words(
    cut: list[tuple[np.ndarray, np.ndarray]], tables: Tables, between: np.ndarray | None = None, carry: int = 2
) -> Iterator[tuple[Words, int]]:
    """The words of each piece that `runs` gives of some rows, and how many in front are the last `carry` ones of the piece before."""
    tail: list[bytes] = []
    for data, limits in cut:
        if tail:
            front = np.frombuffer(b"".join(word + b" " for word in tail), np.uint8)
            data = np.concatenate([front, data])
            limits = np.array([0, len(data)])
        words = Words(data, limits, tables, between)
        yield words, len(tail)
        if len(cut) > 1:
            tail = [data[a:b].tobytes() for a, b in zip(words.starts[-carry:], words.ends[-carry:], strict=True)]


def bins(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)
