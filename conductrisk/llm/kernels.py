"""Numpy helpers over a batch of texts: words, hashes of words and of runs of words, sliding minima.

A batch is one Arrow string array. Its bytes lie in one buffer, so words, hashes and windows of all
texts are found with a few array operations and no loop over words. All hashes are the same in
every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in pieces of about so many bytes; a longer text is a piece of its own.
PIECE_BYTES = 4_000_000

#: Separators of words: blank and the five control characters from tab to carriage return.
BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True
#: Separators of plain words: all ASCII characters but letters.
NOT_LETTERS = np.ones(256, bool)
NOT_LETTERS[128:] = False
NOT_LETTERS[ord("A"):ord("Z") + 1] = NOT_LETTERS[ord("a"):ord("z") + 1] = False

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; the longest table of about a piece is kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 2 * PIECE_BYTES:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, length) of slices whose texts have about `limit` bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = total = 0
    for i, size in enumerate(sizes):
        if i > first and total + size > limit:
            yield first, i - first
            first, total = i, 0
        total += size
    if len(sizes) > first:
        yield first, len(sizes) - first


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of the texts); a null text is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


@dataclass
class Words:
    """The words of a batch: byte spans, and for each text its first word (one entry more at the end)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    of_text: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.of_text)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of_text) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        total = (self.data.astype(np.uint64) + np.uint64(1)) * _powers(_ODD, len(self.data))
        np.cumsum(total, out=total)
        before = np.where(self.start > 0, total[self.start - 1], np.uint64(0))
        value = (total[self.end - 1] - before) * _powers(_ODD_INVERSE, len(self.data))[self.start]
        return mix(value ^ (self.end - self.start).astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANKS) -> Words:
    inside = ~separators[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def run_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive values, by doubling; len(values) - k + 1 of them."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    part, length, out, done = values.astype(np.uint64), 1, None, 0
    factor = int(_ODD)
    while True:
        if k & length:  # the run is put together from pieces whose lengths are powers of two
            piece = part[done:done + n]
            out = piece.copy() if out is None else out * np.uint64(factor) + piece
            done += length
        if length * 2 > k:
            return mix(out + np.uint64(k))
        part = part[:-length] * np.uint64(factor) + part[length:]
        factor = factor * factor % (1 << 64)
        length *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    part, length = values, 1
    while length * 2 <= width:
        part = np.minimum(part[:-length], part[length:])
        length *= 2
    return np.minimum(part[:n], part[width - length:width - length + n])


_PLACE_BITS = np.uint64(28)


@dataclass
class Runs:
    """Runs of consecutive windows that share an anchor: first window, number of windows, place and hash of the anchor."""

    first: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    value: np.ndarray


def anchored_runs(tokens: np.ndarray, of_text: np.ndarray, window: int, phrase: int) -> Runs:
    """Cut the windows of each text into runs by their anchor.

    The anchor of a window is its phrase (`phrase` consecutive tokens) with the smallest hash, the
    leftmost of equal ones; it depends on the window's content alone, so equal windows have the
    same anchor at the same place. `of_text` holds the first token of each text.
    """
    ends = np.repeat(of_text[1:], np.diff(of_text))
    windows = np.flatnonzero(ends - np.arange(len(tokens)) >= window)
    if not len(windows):
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, np.zeros(0, np.uint64))
    phrases = run_hashes(tokens, phrase)
    ranked = (phrases >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(phrases), dtype=np.uint64)
    anchor = sliding_min(ranked, window - phrase + 1)[windows] & np.uint64((1 << 28) - 1)
    begins = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.append(begins, len(windows)))
    place = anchor[begins].astype(np.int64)
    return Runs(windows[begins], count, place, phrases[place])


def covered(first: np.ndarray, count: np.ndarray, window: int, n: int) -> np.ndarray:
    """Mask of n tokens: those inside a window that starts in [first, first + count)."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, np.minimum(first + count + window - 1, n), -1)
    return np.cumsum(steps[:-1]) > 0


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i; 0 for an empty stretch."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]
