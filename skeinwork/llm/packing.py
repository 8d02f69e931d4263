"""Best-two-fit packing of tokenized documents into sequences of a fixed capacity.

Only lengths decide a packing and there are at most ``capacity`` of them, so the driver gets a histogram (at most ``capacity`` rows,
whatever the input) and plans bins for all documents at once: fill a bin greedily, largest first; if a gap is left, replace the
bin's smallest document by the two unpacked ones that fill the widened gap best. A bin's pattern repeats while its lengths last,
so the plan is a short list of (copies, lengths). Documents then find their place from their rank within their length: ranks come
from counts by (length, bucket) and a window within each; a length has buckets as its count asks, so no group grows with the input.

Edge cases: a null or empty text is the end id alone; only documents longer than the capacity are cut; rows alike in id, piece and ids
are interchangeable; a null doc_id is kept; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.llm.common import blocks, stored, text_batches, text_views, tidied
from skeinwork.llm.tokens import encoder, with_end

CAPACITY = 2048
#: Documents of one length that are ranked together (about): a length has as many buckets as that takes.
RANKED = 1 << 17
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """One row per piece of every document: its place in the document, length and checksum."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            raw, offsets = text_views(batch.column(1))
            for i, j in blocks(offsets, 2 << 20):
                ids, bounds = with_end(*encode(raw, offsets[i : j + 1]), end)
                sizes = np.diff(bounds)
                count = -(-sizes // capacity)
                row = np.repeat(np.arange(j - i), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                at = bounds[row] + start
                view = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), PIECES)


class Shelf:
    """Counts of unpacked documents by length, with the largest length at most x still there."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts.copy()
        self.refresh()

    def refresh(self) -> None:
        self.at_most = np.maximum.accumulate(np.where(self.counts > 0, np.arange(len(self.counts)), 0))

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            self.refresh()

    def best_pair(self, gap: int) -> tuple[int, int]:
        """The two lengths (a >= b) with the greatest sum within ``gap``; (0, 0) if there is no pair."""
        a = np.flatnonzero(self.counts[: gap + 1] > 0)
        if not len(a):
            return 0, 0
        b = np.minimum(self.at_most[gap - a], a)
        same = (b == a) & (self.counts[a] < 2)
        b = np.where(same, self.at_most[np.maximum(a - 1, 0)], b)
        total = np.where(b > 0, a + b, 0)
        k = int(np.argmax(total))
        return (int(a[k]), int(b[k])) if total[k] else (0, 0)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """``counts[x]``: documents of length x. Patterns: (copies, lengths in the order of their places)."""
    shelf, out = Shelf(np.asarray(counts, np.int64)), []
    while largest := int(shelf.at_most[capacity]):
        before = shelf.counts.copy()
        bin_, gap = [], capacity
        while length := int(shelf.at_most[min(gap, largest)]):
            n = min(gap // length, int(shelf.counts[length]))
            bin_ += [length] * n
            shelf.take(length, n)
            gap -= n * length
        tried = []  # the document that gives way
        if gap and len(bin_) > 1:
            smallest = bin_[-1]
            a, b = shelf.best_pair(gap + smallest)
            if a + b > smallest:
                bin_, tried = [*bin_[:-1], a, b], [smallest]
        used = np.bincount(bin_, minlength=len(before))
        kinds, need = np.flatnonzero(used), used.copy()
        need[tried] += 1  # the same bin comes about again while what was tried for it is there too
        copies = max(1, int(((before[kinds] - need[kinds]) // used[kinds]).min()) + 1)
        shelf = Shelf(before - copies * used)
        out.append((copies, bin_))
    return out


def places(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Runs of equal lengths of each pattern, by (length, first rank): where a document of that length and rank goes."""
    rows, ranks, sequence = [], {}, 0
    for copies, lengths in patterns:
        offset = 0
        for length in dict.fromkeys(lengths):
            n = lengths.count(length)
            first = ranks.get(length, 0)
            rows.append((length, first, copies, sequence, offset))
            ranks[length] = first + n * copies
            offset += n * length
        sequence += copies
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "copies", "sequence", "offset"), table.T, strict=True))


def pack(parts: DataFrame, capacity: int = CAPACITY, ranked: int = RANKED) -> DataFrame:
    """``parts``: a stored table with doc_id, piece and length (at most the capacity). Adds sequence_id and offset."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in parts.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    table = places(plan(counts, capacity))
    keys = table["length"] << 44 | table["first"]  # ranks stay below 2**44

    names = parts.columns
    # full pieces of long documents may be most of all rows; the other lengths share a number
    full, other = (-(-int(n) // ranked) or 1 for n in (counts[capacity], counts[:capacity].max(initial=0)))
    buckets = F.when(F.col("length") == capacity, full).otherwise(other)
    rows = parts.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece"), buckets).cast("int"))
    earlier = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("length", "__bucket").agg(F.count("*").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    within = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", *[c for c in names if c not in ("doc_id", "piece", "length")])
    placed = rows.withColumn("__row", F.row_number().over(within)).join(base.drop("__n"), ["length", "__bucket"]).select(
        *names, (F.col("__base") + F.col("__row") - 1).alias("__rank")
    )
    at = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(at).to_numpy(), batch.column(len(names)).to_numpy()
            k = np.searchsorted(keys, length << 44 | rank, "right") - 1
            nth, copy = np.divmod(rank - table["first"][k], table["copies"][k])
            found = [table["sequence"][k] + copy, table["offset"][k] + nth * length]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *map(pa.array, found)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return placed.mapInArrow(tidied(run), schema)


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack every document. The pieces are stored first, so ranks do not change if an executor is lost."""
    return pack(stored(pieces(docs, path, capacity), "pieces"), capacity)
