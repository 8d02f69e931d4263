"""Quality classifier: naive Bayes support vectors.

A text is a set of n-grams: of its words (one and two), and of its words' shapes (one to three: letters, capitals, signs, repetition). Every
n-gram's indicator is scaled by its naive Bayes log-count ratio and the row to unit length; dual coordinate descent fits a linear
hinge-loss model to the rows, and a logistic curve turns margins into scores. The model is a pair of tables of fixed size, whatever the
input. It is fitted on at most ``sample`` labelled documents with at most MOST feature numbers, those with the smallest
hashes of their ids; every document is scored.

Edge cases: null and empty texts have no n-grams and get the score of the bias; null labels and labels of unknown documents are not learned from,
repeated labels of a document count as the least of them; rows that repeat get equal scores; without any labelled row of either class the score is
the share of label 1 (0.5 without labels); an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import blocks, stored, text_batches, text_views, tidied
from skeinwork.llm.lexer import U, Lexed, lex, mix, row_sums, windows

#: Labelled documents to learn from at most, feature numbers (4 bytes each) that they may have in all, and bits of a feature's number.
SAMPLE, MOST, BITS = 8192, 1 << 25, 18
CLASS = np.zeros(256, np.uint8)
CLASS[[*range(48, 58)]] = 1
CLASS[[*range(97, 123)]] = 2
CLASS[[*range(65, 91)]] = 3
CLASS[[ord(c) for c in ".,;:"]] = 4
CLASS[[ord(c) for c in "!?"]] = 5
CLASS[128:] = 6


def shapes(lexed: Lexed, words: np.ndarray) -> np.ndarray:
    """A small number for each word: its first and last characters' classes, capitals, signs, and whether it repeats the word before."""
    if not len(lexed.start):
        return np.zeros(0, U)
    kind = CLASS[lexed.data]
    sums = lambda flags: np.concatenate(([0], np.cumsum(flags)))
    many = lambda c: np.minimum(2, c[lexed.end] - c[lexed.start])
    capital, sign = many(sums(kind == 3)), many(sums((kind == 0) | (kind == 5)))
    again = np.zeros(len(words), np.int64)
    again[1:] = (words[1:] == words[:-1]) & (lexed.doc[1:] == lexed.doc[:-1])
    code = kind[lexed.start].astype(np.int64)
    for part, size in ((kind[lexed.end - 1], 7), (capital, 3), (sign, 3), (again, 2)):
        code = code * size + part
    return mix(code.astype(U) + U(1))


def features(lexed: Lexed, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers, row by row, and bounds (n + 1)."""
    words = lexed.hashes(lower=True)
    form = shapes(lexed, words)
    keys = []
    for salt, (hashes, width) in enumerate(((words, 1), (words, 2), (form, 1), (form, 2), (form, 3))):
        found, at = windows(hashes, lexed.doc, width)
        number = mix(found + U(salt + 1)) >> U(64 - bits)
        keys.append(lexed.doc[at] << bits | number.astype(np.int64))
    both = np.sort(np.concatenate(keys))
    both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
    return both & ((1 << bits) - 1), np.searchsorted(both >> bits, np.arange(lexed.rows + 1))


@dataclass
class Model:
    """Margin of a text: sum of ``gain`` over its features / sqrt(sum of ``norm``) + bias; score: the logistic of slope * margin + shift."""

    gain: np.ndarray
    norm: np.ndarray
    bias: float
    slope: float
    shift: float
    bits: int

    def scores(self, feats: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        margin = row_sums(self.gain[feats], bounds) / np.sqrt(np.maximum(row_sums(self.norm[feats], bounds), 1e-12)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def log_count_ratios(feats: np.ndarray, rows: np.ndarray, y: np.ndarray, size: int, alpha: float = 1.0) -> np.ndarray:
    positive = np.bincount(feats[y[rows] > 0], minlength=size) + alpha
    negative = np.bincount(feats[y[rows] < 0], minlength=size) + alpha
    return np.log((positive / positive.sum()) / (negative / negative.sum()))


def dual_descent(feats: np.ndarray, values: np.ndarray, bounds: np.ndarray, y: np.ndarray, cost: np.ndarray, size: int, epochs: int = 15, least: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights (the last one is the bias) that minimise |w|^2 / 2 + sum of cost * hinge loss, one dual variable at a time, until none moves by ``least``."""
    w, alpha = np.zeros(size + 1), np.zeros(len(y))
    square = np.array([1 + (values[a:b] ** 2).sum() for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(y)):
            at = slice(bounds[i], bounds[i + 1])
            gradient = y[i] * (w[feats[at]] @ values[at] + w[size]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[feats[at]] += step * values[at]
                w[size] += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < least:
            break
    return w


def logistic_fit(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift by Newton's method, with Platt's targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    theta, x = np.array([1.0, 0.0]), np.column_stack([margin, np.ones(len(margin))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - target))
        theta = theta - step
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def fit(feats: np.ndarray, bounds: np.ndarray, label: np.ndarray, bits: int = BITS, cost: float = 1.0, blend: float = 0.25) -> Model:
    """``blend``: how much of each weight stays; the rest is the mean weight, as the naive Bayes model would have it."""
    size = 1 << bits
    y = np.where(label > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        share = np.clip((y > 0).mean(), 0.001, 0.999) if len(y) else 0.5
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))), bits)
    rows = np.repeat(np.arange(len(y)), np.diff(bounds))
    ratio = log_count_ratios(feats, rows, y, size)
    length = np.sqrt(np.maximum(np.bincount(rows, weights=ratio[feats] ** 2, minlength=len(y)), 1e-12))
    values = ratio[feats] / length[rows]
    costs = cost * np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    w = dual_descent(feats, values, bounds, y, costs, size)
    weights = (1 - blend) * np.abs(w[:size]).mean() + blend * w[:size]
    margin = np.bincount(rows, weights=values * weights[feats], minlength=len(y)) + w[size]
    slope, shift = logistic_fit(margin, y)
    return Model((ratio * weights).astype(np.float32), (ratio**2).astype(np.float32), float(w[size]), slope, shift, bits)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int, bits: int, most: int = MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, bounds and labels of the sample: in the order of their ids' hashes, at most ``sample`` documents with at most ``most`` feature numbers
    in all come to the driver."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    chosen = chosen.select("doc_id", "label", F.xxhash64("doc_id").alias("hash")).orderBy("hash", "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("label", "hash", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_views(batch.column(2))
            for i, j in blocks(offsets):
                found, bounds = features(lex(raw, offsets[i : j + 1]), bits)
                parts = [found[bounds[k] : bounds[k + 1]].astype(np.uint32).tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(bounds)), pa.array(parts, pa.binary())], names=["label", "hash", "n", "features"]
                )

    found = stored(texts.mapInArrow(tidied(run), "label int, hash long, n long, features binary"), "labelled")
    held, last = 0, None
    for r in sorted(found.groupBy("hash").agg(F.sum("n").alias("n")).collect()):  # at most ``sample`` rows
        held += r["n"]
        if held > most:
            break
        last = r["hash"]
    found = found.where(F.col("hash") <= last) if last is not None else found.limit(0)
    rows = found.select("label", "features").toArrow().sort_by([("label", "ascending"), ("features", "ascending")])
    parts = [np.frombuffer(x, np.uint32).astype(np.int64) for x in rows.column("features").to_pylist()]
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), bounds, rows.column("label").to_numpy()


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_views(batch.column(2))
            for i, j in blocks(offsets):
                scores = model.scores(*features(lex(raw, offsets[i : j + 1]), model.bits))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """Fit on the labelled sample, score every document."""
    text_batches(docs.sparkSession)
    return score(docs, fit(*labelled(docs, labels, label, sample, bits), bits=bits))
