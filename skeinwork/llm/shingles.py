"""Sets of word shingles as 64-bit hashes, and b-bit MinHash signatures over them."""

from __future__ import annotations

import numpy as np

from skeinwork.llm.lexer import Lexed, U, mix, windows

#: Symbols of a signature, bits of a symbol (kept in uint16), symbols of a chunk and errors enumerated in it.
SYMBOLS, BITS, CHUNK, ERRORS = 52, 16, 4, 1
#: By the pigeonhole principle a pair at this distance or less agrees in some chunk but for ERRORS symbols.
RADIUS = (ERRORS + 1) * (SYMBOLS // CHUNK) - 1
MULTIPLIERS = mix(np.arange(1, SYMBOLS + 1, dtype=U) * U(0xD1342543DE82EF95)) | U(1)


def shingle_sets(lexed: Lexed, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ordered by row and value, and bounds (n + 1). Rows with fewer words than ``width`` have their whole
    sequence as one shingle, rows without words none."""
    words = lexed.hashes(lower=True)
    found, at = windows(words, lexed.doc, width)
    row = lexed.doc[at]
    count = lexed.counts()
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        whole = np.array([_whole(words[lexed.first[k] : lexed.first[k + 1]]) for k in short], U)
        found, row = np.concatenate([found, whole]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        found, row = found[order], row[order]
    bounds = np.searchsorted(row, np.arange(lexed.rows + 1))
    out, sizes = [], np.zeros(lexed.rows + 1, np.int64)
    for k in range(lexed.rows):
        part = np.unique(found[bounds[k] : bounds[k + 1]])
        out.append(part)
        sizes[k + 1] = len(part)
    return np.concatenate(out) if out else found, np.cumsum(sizes)


def _whole(words: np.ndarray) -> np.uint64:
    h = np.array([len(words)], U)
    for w in words:
        h = mix(h * U(0x9FB21C651E98DF25) + w)
    return h[0]


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of SYMBOLS symbols (uint16) per non-empty set; rows of empty sets are 0."""
    n = len(bounds) - 1
    out = np.zeros((n, SYMBOLS), np.uint16)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        starts = bounds[full]
        for s, a in enumerate(MULTIPLIERS):
            low = np.minimum.reduceat(sets * a, starts)
            out[full, s] = (mix(low) >> U(64 - BITS)).astype(np.uint16)
    return out


def set_names(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name each set: equal sets, and for all practical purposes only those, have equal names."""
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A35):
        sums = np.zeros(len(sets) + 1, U)
        np.cumsum(mix(sets ^ U(salt)), out=sums[1:])
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """Per row, a 64-bit key for every chunk and every choice of the symbol that may differ; its low six bits are its column."""
    n = len(signature)
    keys = np.zeros((n, SYMBOLS), U)
    symbols = signature.astype(U)
    for c in range(SYMBOLS // CHUNK):
        part = symbols[:, c * CHUNK : (c + 1) * CHUNK]
        for gone in range(CHUNK):
            h = np.zeros(n, U)
            for k in range(CHUNK):
                if k != gone:
                    h = (h << U(BITS)) | part[:, k]
            column = c * CHUNK + gone
            keys[:, column] = mix(h + U((column + 1) * 0xA0761D6478BD642F % 2**64)) & ~U(63) | U(column)
    return keys


def first_shared_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of signatures, the column in ``chunk_keys`` of the first key they share, or -1."""
    same = (a == b).reshape(len(a), SYMBOLS // CHUNK, CHUNK)
    agree = same.sum(axis=2)
    near = agree >= CHUNK - ERRORS
    chunk = near.argmax(axis=1)
    odd = np.where(agree[np.arange(len(a)), chunk] == CHUNK, 0, (~same[np.arange(len(a)), chunk]).argmax(axis=1))
    return np.where(near.any(axis=1), chunk * CHUNK + odd, -1)
