"""License scans: winnowed fingerprints, an inverted index of templates, and banded alignment.

Template and text are sequences of lower-case words (letters and digits; other ASCII separates). Winnowing keeps the least hash of every
window of neighbouring word trigrams, so any run of ``GRAM + WINDOW - 1`` words that a text shares with a template gives a common
fingerprint; templates shorter than that put all their trigrams into an index of their own, which is held against all of a text's.
Hits of a template at about the same diagonal (place in the text less place in the template) are a candidate, if enough of the template's words are
there at all. A banded alignment around the diagonal gives the template words matched and the span of the text, for every copy in the
candidate: short notices that follow one another have diagonals so near that they are one candidate. Spans below the coverage asked for are dropped,
and so are those of headers, notices and tags whose deciding words (version numbers, "lesser", "nc" and the like) are not the template's. Of
overlapping spans the one with the most matched words stays, then that of the greater coverage, then that of the template listed first.

Edge cases: null and empty texts match nothing; texts are scanned whole; a template that occurs several times is reported each time; rows that
repeat are reported each; an empty table gives an empty result; extra columns are not read. Spans are in code points, end exclusive.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import blocks, text_batches, text_views, tidied
from skeinwork.llm.lexer import Lexed, lex, windows
from skeinwork.llm.license_texts import DECIDING, TEMPLATES

#: Words of a fingerprint, neighbouring fingerprints of which one is kept, diagonals that a candidate may spread over, least coverage.
GRAM, WINDOW, BAND, COVERAGE = 3, 2, 12, 0.8
MATCH, MISMATCH, GAP = 2, -1, -1

SEPARATORS = np.zeros(256, bool)
SEPARATORS[:128] = True
SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[Lexed, np.ndarray]:
    lexed = lex(raw, offsets, SEPARATORS)
    return lexed, lexed.hashes(lower=True)


def winnow(grams: np.ndarray, doc: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Indices of the grams that are the least (the last of equals) of a window of their text; all of a text with fewer than ``width``."""
    n = len(grams)
    keep = np.zeros(n, bool)
    if n >= width:
        view = np.lib.stride_tricks.sliding_window_view(grams, width)
        inside = doc[: n - width + 1] == doc[width - 1 :]
        last = width - 1 - np.argmin(view[:, ::-1], axis=1)
        keep[(np.arange(n - width + 1) + last)[inside]] = True
    if n:
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        size = np.diff(np.append(first, n))
        for a, m in zip(first[size < width], size[size < width], strict=True):
            keep[a : a + m] = True
    return np.flatnonzero(keep)


class Index:
    """Fingerprints of the templates: hash -> (template, place)."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names, self.words, self.strict = list(templates), [], [name.endswith((" header", " notice", " tag")) for name in templates]
        data = " ".join(DECIDING).encode()
        self.deciding = set(words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[1].tolist())
        kept: dict[bool, list[tuple[int, int, int]]] = {True: [], False: []}
        for k, text in enumerate(templates.values()):
            data = np.frombuffer(text.encode(), np.uint8)
            lexed, words = words_of(data, np.array([0, len(data)]))
            self.words.append(words.tolist())
            grams, at = windows(words, lexed.doc, GRAM)
            short = len(words) < GRAM + WINDOW - 1
            chosen = np.arange(len(grams)) if short else winnow(grams, np.zeros(len(grams), np.int64))
            kept[short] += [(int(grams[i]), k, int(at[i])) for i in chosen]
        self.tables = {short: self.table(rows) for short, rows in kept.items()}

    def decided(self, words: list[int]) -> list[int]:
        return [w for w in words if w in self.deciding]

    @staticmethod
    def table(rows: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = sorted(rows)
        return np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)

    def hits(self, grams: np.ndarray, at: np.ndarray, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Template, its place and the text's word for every common fingerprint."""
        keys, template, place = self.tables[short]
        low, high = np.searchsorted(keys, grams, "left"), np.searchsorted(keys, grams, "right")
        found = np.flatnonzero(high > low)
        reps = high[found] - low[found]
        entry = np.repeat(low[found] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
        return template[entry], place[entry], np.repeat(at[found], reps)


def alignments(template: list[int], text: list[int], diagonal: int, band: int, least: int) -> list[tuple[int, int, int, int]]:
    """Local alignments with text index - template index within ``band`` of ``diagonal`` and at least ``least`` matched words: for every word of the
    text that one ends at, the best one's score, matched words, first and last + 1 word."""
    none = (0, 0, 0, 0)  # score, matches, -start, end
    out, before = [], {}
    for j, word in enumerate(text):
        column: dict[int, tuple[int, int, int, int]] = {}
        best = none
        for i in range(max(0, j - diagonal - band), min(len(template), j - diagonal + band + 1)):
            s, m, a, _ = before.get(i - 1, none)
            same = word == template[i]
            start = a if s > 0 else -j
            cell = (s + MATCH, m + 1, start, j + 1) if same else (s + MISMATCH, m, start, j + 1)
            for s, m, a, e in (column.get(i - 1, none), before.get(i, none)):
                cell = max(cell, (s + GAP, m, a, e))
            if cell[0] > 0:
                column[i] = cell
                if same and cell[1] >= least and cell[:2] > best[:2]:
                    best = cell
        if best[0]:
            out.append((best[0], best[1], -best[2], best[3]))
        before = column
    return out


def complete(template: list[int], words: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """Which of the ranges of words hold so many of the template's words, repeats counted up to the template's, that ``least`` could be matched."""
    order = np.argsort(words, kind="stable")
    ordered, found = words[order], np.zeros(len(starts), np.int64)
    for word, n in Counter(template).items():
        a, b = np.searchsorted(ordered, np.uint64(word), "left"), np.searchsorted(ordered, np.uint64(word), "right")
        at = order[a:b]
        found += np.minimum(n, np.searchsorted(at, ends, "left") - np.searchsorted(at, starts, "left"))
    return found >= least


def copies(
    template: list[int], text: list[int], diagonal: int, band: int, least: int, hits: list[int], sound: Callable[[list[int]], bool] = lambda words: True
) -> list[tuple[int, int, int]]:
    """Matched words, first and last + 1 word of ``sound`` alignments that don't overlap: the best ones first, then those in what these leave of the
    text, until no hit (words of the text, in order) is left that another one could cover."""
    out, todo = [], [(0, len(text))]
    while todo:
        begin, end = todo.pop()
        covered, kept = bytearray(end - begin), []
        for _, matched, a, b in sorted(alignments(template, text[begin:end], diagonal - begin, band, least), key=lambda x: (-x[0], -x[1], x[2])):
            if not any(covered[a:b]) and sound(text[begin + a : begin + b]):
                covered[a:b] = b"\1" * (b - a)
                kept.append((begin + a, begin + b, matched))
        kept.sort()
        out += [(matched, a, b) for a, b, matched in kept]
        for x, y in zip([begin, *(b for _, b, _ in kept)], [*(a for a, _, _ in kept), end], strict=True) if kept else ():
            if y - x >= least and bisect_left(hits, x) < bisect_left(hits, y):
                todo.append((x, y))
    return out


def found_in(index: Index, lexed: Lexed, words: np.ndarray, coverage: float) -> list[tuple[int, int, float, int, int, int]]:
    """(row, template, coverage, matched words, first byte, end byte) of every match."""
    grams, at = windows(words, lexed.doc, GRAM)
    thin = winnow(grams, lexed.doc[at])
    parts = [index.hits(grams[thin], at[thin], False), index.hits(grams, at, True)]
    template, place, word = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(template):
        return []
    row, diagonal = lexed.doc[word], word - place
    size = np.array([len(w) for w in index.words])
    least = np.maximum(1, np.ceil(coverage * size - 1e-9).astype(np.int64))
    # of repetitive texts most hits go here, in a few array passes
    low, high = np.maximum(lexed.first[row], diagonal - BAND), np.minimum(lexed.first[row + 1], diagonal + size[template] + BAND)
    able = np.zeros(len(row), bool)
    for k in np.unique(template):
        own = np.flatnonzero(template == k)
        able[own] = complete(index.words[k], words, low[own], high[own], int(least[k]))
    row, template, diagonal, word = row[able], template[able], diagonal[able], word[able]
    if not len(row):
        return []
    order = np.lexsort((diagonal, template, row))
    row, template, diagonal, word = row[order], template[order], diagonal[order], word[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (template[1:] != template[:-1]) | (diagonal[1:] - diagonal[:-1] > BAND)
    starts = np.flatnonzero(new)
    out: dict[int, list[tuple[int, float, int, int, int]]] = {}
    for a, b in zip(starts, np.append(starts[1:], len(row)), strict=True):
        r, t, low, high = int(row[a]), int(template[a]), int(diagonal[a]), int(diagonal[b - 1])
        known = index.words[t]
        begin = max(int(lexed.first[r]), low - BAND)
        end = min(int(lexed.first[r + 1]), high + len(known) + BAND)
        hits, wanted = sorted(set((word[a:b] - begin).tolist())), index.decided(known)
        sound = (lambda some, wanted=wanted: index.decided(some) == wanted) if index.strict[t] else lambda some: True
        for matched, first, last in copies(known, words[begin:end].tolist(), (low + high) // 2 - begin, BAND + (high - low + 1) // 2, int(least[t]), hits, sound):
            out.setdefault(r, []).append((matched, matched / len(known), -t, begin + first, begin + last))
    result = []
    for r, many in out.items():
        zero = int(lexed.first[r])
        taken = bytearray(int(lexed.first[r + 1]) - zero)
        for matched, share, t, a, b in sorted(set(many), reverse=True):
            if not any(taken[a - zero : b - zero]):
                taken[a - zero : b - zero] = b"\1" * (b - a)
                result.append((r, -t, share, matched, int(lexed.start[a]), int(lexed.end[b - 1])))
    return sorted(result, key=lambda x: (x[0], x[4]))


def code_points(lexed: Lexed, found: list[tuple[int, int, float, int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends in code points; matches are in order and don't overlap, so every byte is counted once."""
    starts, ends = [], []
    row, at, n = -1, 0, 0
    for r, _, _, _, *span in found:
        if r != row:
            row, at, n = r, int(lexed.text_start[r]), 0
        for x, out in zip(span, (starts, ends), strict=True):
            n, at = n + int(np.count_nonzero((lexed.data[at:x] & 0xC0) != 0x80)), x
            out.append(n)
    return starts, ends


SCHEMA = "doc_id long, license string, coverage double, matched_words int, span_start long, span_end long"


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per license text found in a document."""
    text_batches(docs.sparkSession)
    index = Index(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_views(batch.column(1))
            for i, j in blocks(offsets):
                lexed, words = words_of(raw, offsets[i : j + 1])
                found = found_in(index, lexed, words, coverage)
                if not found:
                    continue
                row, template, share, matched, _, _ = zip(*found, strict=True)
                points = code_points(lexed, found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(row)), pa.array([index.names[t] for t in template]), pa.array(share, pa.float64()), pa.array(matched, pa.int32()), *(pa.array(p, pa.int64()) for p in points)],
                    names=["doc_id", "license", "coverage", "matched_words", "span_start", "span_end"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), SCHEMA)
