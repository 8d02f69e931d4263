"""Quality rules: compression bands.

Each text's UTF-8 bytes are compressed with zstandard, whole and in fixed chunks. Repetitive text compresses too well and noise too
badly, and both depend on length, so the limits are bands by length. A document goes if its whole ratio leaves its band, or if more
than a share of its chunks leave theirs: full chunks that of chunks, the last partial one that of texts of its length. The base counts come
from vectorised passes over the same bytes.

Edge cases: null and empty texts have no words, so the base rule fails them; a text shorter than one chunk has no chunks of its own and
only the whole band decides; repeated rows get equal verdicts; an empty table gives an empty result; extra columns are not read.
Very long texts are compressed whole, in bounded memory besides the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import blocks, text_batches, text_views, tidied
from skeinwork.llm.lexer import Lexed, lex, mix, per_row, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Bands:
    """``whole``: (bytes below which the limits hold, lowest ratio, highest ratio), ascending; the last has no upper length."""

    whole: tuple[tuple[float, float, float], ...] = (
        (128, 0.45, 2.00), (256, 0.42, 1.70), (512, 0.49, 0.95), (768, 0.485, 0.80), (1024, 0.47, 0.78), (1536, 0.455, 0.74),
        (2048, 0.445, 0.72), (4096, 0.425, 0.68), (8192, 0.395, 0.66), (16384, 0.375, 0.65), (float("inf"), 0.30, 0.65),
    )
    chunk: int = 1024
    #: Limits of a full chunk, and the share of a text's chunks that may be outside.
    chunks: tuple[float, float] = (0.50, 0.70)
    outside: float = 0.25
    level: int = 3


SCHEMA = """doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean,
            ratio double, n_chunks long, chunks_outside long"""


def repeated_words(lexed: Lexed, hashes: np.ndarray, width: int = 3) -> np.ndarray:
    """Per row: words that lie in a window of ``width`` words found at least twice in the row."""
    found, at = windows(hashes, lexed.doc, width)
    covered = np.zeros(len(hashes) + width, bool)
    if len(found):
        keys = mix(found ^ (lexed.doc[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        ordered = np.sort(keys)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
            hit = at[twice[place] == keys]
            for k in range(width):
                covered[hit + k] = True
    return per_row(covered[: len(hashes)], lexed.first)


def duplicate_lines(lexed: Lexed) -> np.ndarray:
    """Per row: lines with a word that equal an earlier line of the row."""
    breaks = lexed.data == 0x0A
    breaks[lexed.text_start[1:] - 1] = True  # the space after each text ends its last line
    end = np.flatnonzero(breaks)
    start = np.concatenate(([0], end[:-1] + 1))
    words = np.concatenate(([0], np.cumsum(~lexed.spaces)))
    real = words[end] > words[start]
    start, end = start[real], end[real]
    out = np.zeros(lexed.rows, np.int64)
    if len(start):
        row = np.searchsorted(lexed.text_start, start, "right") - 1
        keys = mix(lexed.span_hashes(start, end, lower=False) ^ (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        _, first = np.unique(keys, return_index=True)
        later = np.ones(len(keys), bool)
        later[first] = False
        np.add.at(out, row[later], 1)
    return out


def base_counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    lexed = lex(raw, offsets)
    points = ~lexed.spaces & ((lexed.data & 0xC0) != 0x80)
    return {
        "n_words": lexed.counts(),
        "word_chars": per_row(points, lexed.text_start),
        "n_symbols": per_row(SYMBOLS[lexed.data], lexed.text_start),
        "n_dup_lines": duplicate_lines(lexed),
        "n_repeat_words": repeated_words(lexed, lexed.hashes(lower=False)),
    }


def ratios(text: bytes, bands: Bands, press: zstandard.ZstdCompressor) -> tuple[float | None, int, int]:
    """Ratio of the whole text, number of its chunks (none of a text shorter than one), and how many of them are outside their band."""
    if not text:
        return None, 0, 0
    view, size, n, outside = memoryview(text), bands.chunk, 0, 0
    for i in range(0, len(text), size) if len(text) >= size else ():
        part = view[i : i + size]
        low, high = bands.chunks if len(part) == size else limits(len(part), bands)
        n, outside = n + 1, outside + (not low <= len(press.compress(part)) / len(part) <= high)
    return len(press.compress(text)) / len(text), n, outside


def limits(n_bytes: int, bands: Bands) -> tuple[float, float]:
    return next(b for b in bands.whole if n_bytes < b[0])[1:]


def in_bands(n_bytes: int, whole: float | None, chunks: int, outside: int, bands: Bands) -> bool:
    if whole is None:
        return False
    low, high = limits(n_bytes, bands)
    return low <= whole <= high and outside <= bands.outside * chunks


def assess(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Base counts, ratios and verdict of every document."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            raw, offsets = text_views(batch.column(1))
            ids = batch.column(0)
            for i, j in blocks(offsets):
                counts = base_counts(raw, offsets[i : j + 1])
                whole, chunks, outside, inside = [], [], [], []
                for k in range(i, j):
                    text = raw[offsets[k] : offsets[k + 1]].tobytes()
                    found = ratios(text, bands, press)
                    for column, value in zip((whole, chunks, outside), found, strict=True):
                        column.append(value)
                    inside.append(in_bands(len(text), *found, bands))
                words, repeats = counts["n_words"], counts["n_repeat_words"]
                failed = (words < 50) | (100 * repeats > 50 * words)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), *map(pa.array, counts.values()), pa.array(failed), pa.array(~failed & np.array(inside, bool)),
                     pa.array(whole, pa.float64()), pa.array(chunks, pa.int64()), pa.array(outside, pa.int64())],
                    names=["doc_id", *counts, "base_failed", "kept", "ratio", "n_chunks", "chunks_outside"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), SCHEMA)


def kept_documents(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` whose texts pass, with all their columns, in one pass and without a join."""
    text_batches(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            raw, offsets = text_views(batch.column(place))
            keep = np.zeros(batch.num_rows, bool)
            for i, j in blocks(offsets):
                counts = base_counts(raw, offsets[i : j + 1])
                words, repeats = counts["n_words"], counts["n_repeat_words"]
                for k in i + np.flatnonzero((words >= 50) & (100 * repeats <= 50 * words)):
                    text = raw[offsets[k] : offsets[k + 1]].tobytes()
                    keep[k] = in_bands(len(text), *ratios(text, bands, press), bands)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(tidied(run), docs.schema)
