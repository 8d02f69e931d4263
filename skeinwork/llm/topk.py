"""Exact top-k search by inner product, on an impact-ordered index processed score-at-a-time.

Vectors become integers, floor(1024 x). Candidates are dealt into blocks; each has an index: for every dimension, postings in segments of
equal quantised value. A query takes the segments of all dimensions in descending order of impact (query weight times the largest value,
without signs), adds their exact contributions to accumulators, and now and then bounds every candidate from both sides by what its
open dimensions can still add or take. Rows that are proved out go; when a small share is left, those are rescored exactly. Blocks'
winners then meet in a window per query. Queries meet candidates in blocks of bounded size on both sides; neither side is broadcast or collected.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without vec_id; vectors meet only vectors of
their length; ties go to the smaller vec_id; rows that repeat a candidate count each, rows that repeat a query's vec_id are one query (the
least vector) and never its candidates; an empty table gives an empty result; extra columns are not read. Scores must fit 64 bits.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.llm.common import stored

SCALE = 1024
#: Candidates and queries of a block, and quantised impacts of a dimension.
BLOCK, QUERY_BLOCK, LEVELS = 16384, 4096, 32
#: Shares of a block's postings after which the bounds are taken, and the share of rows that are then rescored at once.
STOPS, RESCORE = (0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9, 1.0), 0.35
#: Far more than the rounding of the accumulators, far less than scores differ by: 1.
SLACK = 0.5


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


class Impacts:
    """Postings of a block: per dimension, rows and values in segments of equal quantised value, ascending."""

    def __init__(self, vectors: np.ndarray) -> None:
        n, d = vectors.shape
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        step = np.maximum(1, -(-(high - low + 1) // LEVELS))
        level = ((vectors - low) // step).T  # d x n
        self.rows = np.argsort(level, axis=1, kind="stable")
        level = np.take_along_axis(level, self.rows, axis=1)
        values = np.take_along_axis(vectors.T, self.rows, axis=1)
        new = np.ones((d, n), bool)
        new[:, 1:] = level[:, 1:] != level[:, :-1]
        first = np.flatnonzero(new.ravel())
        self.size = np.diff(np.append(first, n * d))
        self.dimension, self.first = first // n, first % n
        self.impact = np.maximum.reduceat(np.abs(values).ravel(), first)
        self.vectors, self.values, self.floats = vectors, values.astype(np.float64), vectors.astype(np.float64)
        self.norms = (self.floats**2).sum(axis=1)

    def search(self, query: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the query's k best, with exact scores; ``skip``: rows that take no part.

        What a row's open dimensions can still add or take lies within half of scale * (open part of the query's square norm) + (open part
        of its own) / scale, for any scale; a power of two near the norms' ratio is used. Its bounds are kept as two accumulators.
        """
        n, d = self.vectors.shape
        q = query.astype(np.float64)
        square, most_norm = float(q @ q), float(self.norms.max())
        if max(square, most_norm) * 4 >= 2**52:  # beyond exact doubles: every row is rescored
            rows = np.delete(np.arange(n), skip)
            return rows, self.vectors[rows] @ query
        scale = 2.0 ** round(np.log2(max(np.median(self.norms), 1) / max(square, 1)) / 2)
        radius = (scale * square + self.norms / scale) / 2
        upper, lower = radius.copy(), -radius
        impact = np.abs(query)[self.dimension] * self.impact
        order = np.argsort(-impact, kind="stable")
        candidates = np.delete(np.arange(n), skip)
        ends = np.searchsorted(np.cumsum(self.size[order]), np.array(STOPS) * (n * d), "left") + 1
        last = 0
        for cut in ends:
            part = order[last:cut]
            last = int(cut)
            if not len(part):
                continue
            part = np.sort(part)  # neighbouring segments of a dimension are taken as one run
            at = self.dimension[part] * n + self.first[part]
            gap = (at[1:] != (at + self.size[part])[:-1]) | (np.diff(self.dimension[part]) > 0)
            heads = np.flatnonzero(np.concatenate(([True], gap)))
            for a, b in zip(heads, np.append(heads[1:], len(part)), strict=True):
                j, run = self.dimension[part[a]], slice(self.first[part[a]], self.first[part[b - 1]] + self.size[part[b - 1]])
                rows, x = self.rows[j, run], self.values[j, run]
                gain, share = x * q[j], x * x * (0.5 / scale) + 0.5 * scale * q[j] * q[j]
                upper[rows] += gain - share
                lower[rows] += gain + share
            if len(candidates) > k:
                bar = np.partition(lower[candidates], len(candidates) - k)[len(candidates) - k]
                candidates = candidates[upper[candidates] >= bar - SLACK]
            if len(candidates) <= max(RESCORE * n, k):
                break
        return candidates, (self.floats[candidates] @ q).astype(np.int64)


def top_k(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """``vectors``: vec_id, embedding; ``queries``: which rows are queries. query_id, rank, vec_id, score of each query's k best."""
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("v"), queries.alias("__asks")
    )
    rows = stored(rows, "vectors")
    asking = rows.where("__asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    counts = rows.agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("__asks"), F.col("vec_id"))).alias("q")).first()
    blocks, asks = max(1, -(-counts["n"] // BLOCK)), max(1, -(-counts["q"] // QUERY_BLOCK))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asking.select("vec_id", "v", F.size("v").alias("d"), part(asks).alias("ask")).withColumn("block", every(blocks))
    right = rows.select("vec_id", "v", F.size("v").alias("d"), part(blocks).alias("block")).withColumn("ask", every(asks))

    def run(asking: pa.Table, there: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if asking.num_rows and there.num_rows:
            d = there.column("d")[0].as_py()
            matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, d)
            ids = there.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, index = ids[order], Impacts(matrix(there)[order])
            for name, query in zip(asking.column("vec_id").to_numpy(), matrix(asking), strict=True):
                found, score = index.search(query, k, np.arange(np.searchsorted(ids, name), np.searchsorted(ids, name, "right")))
                best = np.lexsort((ids[found], -score))[:k]
                out.append((np.full(len(best), name), ids[found[best]], score[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    keys = ("block", "ask", "d")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
