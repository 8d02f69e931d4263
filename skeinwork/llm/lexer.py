"""Vectorised words: the contract's ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes, with 64-bit hashes of words and lines.

The separators are ASCII, so bytes and code points give the same words. A hash is a polynomial over the bytes, taken from
prefix sums (all words of a block in a few array passes) and finished by a mixing step; equal words have equal hashes and
unequal ones collide with a chance of about 2**-64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
U = np.uint64
#: Bytes whose prefix sums are taken together (a longer word is taken whole).
SEGMENT = 1 << 20
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(which: str, n: int) -> np.ndarray:
    """Powers of the base (``up``) or its inverse (``down``) modulo 2**64."""
    have = _powers[which]
    if len(have) < n:
        base = BASE if which == "up" else INVERSE
        steps = np.full(max(n, 1 << 16), base, U)
        steps[0] = 1
        _powers[which] = have = np.cumprod(steps, dtype=U)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of SplitMix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@dataclass
class Lexed:
    """Texts one after the other, a space after each. Words are in order; ``doc`` gives each word's row."""

    data: np.ndarray
    text_start: np.ndarray  # n + 1: the last is the end
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # n + 1: index of each row's first word
    spaces: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.text_start) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def span_hashes(self, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
        """Hashes of byte ranges, which ascend and don't overlap. Long texts are taken in segments: a hash doesn't depend on its place."""
        out, i = np.empty(len(start), U), 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + SEGMENT, "right")))
            base = start[i]
            part = self.data[base : end[j - 1]]
            sums = np.zeros(len(part) + 1, U)
            values = (LOWER[part] if lower else part).astype(U)
            values += U(1)
            values *= powers("up", len(values))
            np.cumsum(values, out=sums[1:])
            a, b = start[i:j] - base, end[i:j] - base
            out[i:j] = mix((sums[b] - sums[a]) * powers("down", len(sums))[a] + (b - a).astype(U))
            i = j
        return out

    def hashes(self, lower: bool) -> np.ndarray:
        return self.span_hashes(self.start, self.end, lower)


def lex(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> Lexed:
    """``raw``: UTF-8 bytes of all rows; ``offsets``: n + 1 places in it; ``separators``: by byte, the space among them."""
    n = len(offsets) - 1
    offsets = np.asarray(offsets, np.int64)
    raw = raw[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data = np.full(len(raw) + n, 0x20, np.uint8)
    keep = np.ones(len(data), bool)
    text_start = offsets + np.arange(n + 1)
    keep[text_start[1:] - 1] = False
    data[keep] = raw
    spaces = separators[data]
    change = np.flatnonzero(np.diff(np.concatenate(([True], spaces)).astype(np.int8)))
    start, end = change[0::2], change[1::2]
    first = np.searchsorted(start, text_start)
    doc = np.repeat(np.arange(n), np.diff(first))
    return Lexed(data, text_start, start, end, doc, first, spaces)


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds (n + 1); empty ranges give 0."""
    sums = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """As ``per_row`` for doubles, each row summed by itself: equal rows have equal sums, whatever stands around them."""
    out = np.zeros(len(bounds) - 1)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(np.asarray(values, np.float64), bounds[:-1][full])
    return out


def windows(hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words that lies within one row, and the index of its first word."""
    m = len(hashes) - width + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = hashes[:m].copy()
    for k in range(1, width):
        h *= U(0x9FB21C651E98DF25)
        h ^= h >> U(29)
        h += hashes[k : k + m]
    at = np.flatnonzero(doc[:m] == doc[width - 1 :])
    return mix(h[at]), at
