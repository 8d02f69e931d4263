"""Language-model scoring of whole documents: unigram counts of the corpus and a gated recurrent model with a class-factored softmax.

Counts: every training document's words are counted (per task, then by a shuffle), so the table of counts grows with the corpus. Its most
frequent words make two bounded tables for the tasks: the model's coded words, and a larger one of counts. Other words' counts are
joined: each document brings its rare words' hashes, and gets the sum of their log counts back.

Model: a coded word has its own embedding and output; other words share those of their form (their last two bytes), and within a form
they share its rest by their counts, as in the unigram model. Texts are turned to codes once, and that table is stored. Its training
documents fall into shards by a hash of id and text; the number of shards grows with the training tokens. The first shard gives a common
beginning, then every shard, in the order of its hashes, fits the model to all its documents, and the mean of the shards' parameters,
weighted by tokens, is the model. Neither the files of the input nor the number of tasks has a part in that. Scoring carries the state
through the whole document.

Edge cases: null and empty texts are an end alone; long texts are scored whole (in training they are read in parts of a bounded length, all of them);
rows that repeat, or share an id, are scored each; a null doc_id is held out from training; without training documents counts are 0 and the model
predicts alike; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby
from math import ceil
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm import gru
from skeinwork.llm.common import blocks, steady_heap, stored, text_batches, text_views, tidied
from skeinwork.llm.lexer import LOWER, U, Lexed, lex, mix, row_sums

#: Most frequent words whose counts every task gets.
HEAD = 1 << 18
#: Training tokens of a shard (about), how often at most the first one, where it is small, is read to begin with, and tokens that are laid out in lanes together.
SHARD, EPOCHS, TOGETHER = 1 << 21, 8, 1 << 19
#: Step sizes and lanes of the beginning and of the shards.
FIRST_RATE, RATE, FIRST_LANES, SHARD_LANES = 0.01, 0.006, 64, 512
#: Leading bits of a hash by which head words are found.
BUCKET = 19
END = np.uint64(0x5EAF00D5EAF00D11)
#: Distinct words that a task gathers before it sends their counts on, and numbers of means of the shards' models.
GATHER, MEANS = 1 << 18, (256, 16, 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(True))


def forms(lexed: Lexed) -> np.ndarray:
    """The form of each word: one of a fixed number of groups, by its last two bytes."""
    last = LOWER[lexed.data[lexed.end - 1]].astype(U)
    before = np.where(lexed.end - lexed.start > 1, LOWER[lexed.data[np.maximum(lexed.end - 2, 0)]], 0).astype(U)
    return (mix(last << U(8) | before) % U(gru.FORMS)).astype(np.int64)


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))


def counted(docs: DataFrame) -> DataFrame:
    """Training tokens: word (hash), form, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held, ends = 0, 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            word, form, n = (np.concatenate(x) for x in zip(*kept, strict=True))
            names, first, back = np.unique(word, return_index=True, return_inverse=True)
            return names, form[first], np.bincount(back, weights=n).astype(np.int64)

        def rows(word: np.ndarray, form: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(form.astype(np.int32)), pa.array(n)], names=["word", "form", "n"])

        for batch in batches:
            raw, offsets = text_views(batch.column(0))
            ends += batch.num_rows
            for i, j in blocks(offsets):
                lexed = lex(raw, offsets[i : j + 1])
                word, first, n = np.unique(lexed.hashes(lower=True), return_index=True, return_counts=True)
                kept.append((word, forms(lexed)[first], n))
                held += len(word)
                if held > 4 * GATHER:
                    kept = [merged()]
                    held = len(kept[0][0])
                    if held > 2 * GATHER:
                        yield rows(*kept[0])
                        kept, held = [], 0
        if kept:
            yield rows(*merged())
        if ends:
            yield rows(np.array([END]), np.array([0]), np.array([ends]))

    rows = texts(docs).where("not held_out").select("text").mapInArrow(tidied(run, steady=True), "word long, form int, n long")
    return rows.groupBy("word").agg(F.min("form").alias("form"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What tasks know of the counts. ``code``: of a head word, or -1; ``rest``: per form, the sum of (count + 0.1) of its words without a code."""

    keys: np.ndarray
    counts: np.ndarray
    code: np.ndarray
    output: gru.Output
    code_counts: np.ndarray
    rest: np.ndarray
    tokens: int
    distinct: int

    @property
    def end(self) -> int:
        return int(self.code[np.searchsorted(self.keys, END)]) if self.tokens else 0

    @cached_property
    def starts(self) -> np.ndarray:
        """Where the keys of each leading BUCKET bits begin; hashes are spread evenly over them."""
        return np.concatenate(([0], np.cumsum(np.bincount((self.keys >> U(64 - BUCKET)).astype(np.int64), minlength=1 << BUCKET)))).astype(np.int32)

    def places(self, words: np.ndarray) -> np.ndarray:
        """Where words stand among the keys, -1 for none: the few keys of equal leading bits are tried in turn."""
        bucket = (words >> U(64 - BUCKET)).astype(np.int64)
        at, end, place = self.starts[bucket], self.starts[bucket + 1], np.full(len(words), -1)
        live = np.flatnonzero(at < end)
        at, end, words = at[live], end[live], words[live]
        while len(live):
            hit = self.keys[at] == words
            place[live[hit]] = at[hit]
            at += 1
            more = np.flatnonzero(~hit & (at < end))
            at, end, words, live = at[more], end[more], words[more], live[more]
        return place

    def look_up(self, words: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of words, and their counts; -1 for words outside the head."""
        if not len(self.keys):
            return gru.WORDS + form, np.full(len(words), -1)
        at = self.places(words)
        found = at >= 0
        code = np.where(found, self.code[at], -1)
        return np.where(code >= 0, code, gru.WORDS + form), np.where(found, self.counts[at], -1)


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """``counts``: a stored table. At most ``head`` + 1 rows, one row per form and one per step of counts come to the driver."""
    total = counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct")).first()
    # the head is all words from some count up: counts in steps of a 64th of an octave tell which, and no task has to sort them
    step = F.floor(F.log2(F.col("n")) * 64)
    kept, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        kept += r["count"]
        if kept > head:
            break
        least = r["step"]
    end = F.col("word") == int(END.view(np.int64))
    top = counts.where((step >= least) | end if least is not None else end).toArrow()
    word, n, form = (top.column(c).to_numpy() for c in ("word", "n", "form"))
    word = word.view(np.uint64)
    # the end counts as the most frequent word wherever it stands
    order = np.lexsort((word, -n, word != END))
    word, n, form = word[order], n[order], form[order]
    coded = min(len(word), gru.WORDS)
    sums = {r["form"]: (r["n"], r["k"]) for r in counts.groupBy("form").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()}
    rest = np.array([float(sums.get(f, (0, 0))[0] + 0.1 * sums.get(f, (0, 0))[1] + 0.1) for f in range(gru.FORMS)])
    rest -= np.bincount(form[:coded], weights=n[:coded] + 0.1, minlength=gru.FORMS)
    rest = np.maximum(rest, 0.1)
    order = np.argsort(word)
    code = np.where(np.arange(len(word)) < coded, np.arange(len(word)), -1)
    code_counts = np.concatenate([n[:coded], np.zeros(gru.WORDS - coded), rest])
    return Vocabulary(word[order], n[order], code[order], gru.Output.of(form[:coded]), code_counts, rest, int(total["tokens"] or 0), int(total["distinct"]))


CODED = """row long, doc_id long, held_out boolean, hash long, n_tokens long, n_known long, base double, late double, codes binary,
           rare array<long>, times array<int>"""


def coded(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """Per document: its codes (2 bytes each, the end last), what a task can tell of the sums (log10), and the rare words to be looked up. ``late``: what
    its words without a code add to the model's part, their share of their form's rest, as far as the head knows them."""
    log_rest = np.log10(words.rest)
    end_log = np.log10((words.code_counts[words.end] if words.tokens else 0) + 0.1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            raw, offsets = text_views(batch.column(3))
            for i, j in blocks(offsets):
                lexed = lex(raw, offsets[i : j + 1])
                first, hashes, form = lexed.first, lexed.hashes(lower=True), forms(lexed)
                code, count = words.look_up(hashes, form)
                logs = np.where(count >= 0, np.log10(np.maximum(count, 0) + 0.1), 0.0)
                late = np.where(code >= gru.WORDS, logs - log_rest[form], 0.0)
                codes = np.insert(code, first[1:], words.end).astype("<u2")
                data, ends = codes.tobytes(), (2 * (first + np.arange(len(first)))).tolist()
                rare, times = [], []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    these = hashes[a:b][count[a:b] < 0]
                    found, n = np.unique(these, return_counts=True) if len(these) else (these, these)
                    rare.append(found.view(np.int64))
                    times.append(n.astype(np.int32))
                arrays = [
                    pa.array(row + np.arange(j - i)), *(batch.column(k).slice(i, j - i) for k in (0, 1, 2)), pa.array(np.diff(first) + 1),
                    pa.array(row_sums(count > 0, first).astype(np.int64) + (words.tokens > 0)), pa.array(row_sums(logs, first) + end_log), pa.array(row_sums(late, first)),
                    pa.array([data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32())),
                ]
                row += j - i
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "held_out", "hash", "n_tokens", "n_known", "base", "late", "codes", "rare", "times"])

    return texts(docs).select("doc_id", "held_out", F.xxhash64("doc_id", "text").alias("hash"), "text").mapInArrow(tidied(run, steady=True), CODED)


def documents_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2").astype(np.int32) for x in column.to_pylist()]


def together(docs: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Documents in order, in groups of at least TOGETHER tokens but for the last."""
    group, size = [], 0
    for d in docs:
        group.append(d)
        size += len(d)
        if size >= TOGETHER:
            yield group
            group, size = [], 0
    if group:
        yield group


def fitted(rows: DataFrame, words: Vocabulary, shard: int = SHARD) -> gru.Params:
    """``rows``: the stored codes. Fit to all training documents, shard by shard; the weighted mean of the shards' parameters is the model."""
    params = gru.start(words.output, words.code_counts)
    shards = max(1, ceil(words.tokens / shard))
    train = rows.where("not held_out").select(F.pmod("hash", F.lit(shards)).cast("int").alias("shard"), "hash", "codes")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = [d for batch in batches for d in documents_of(batch.column(2))]
        trainer, size = gru.Trainer(params, words.output, words.end), sum(map(len, docs))
        for _ in range(min(EPOCHS, max(1, shard // size)) if docs else 0):
            for group in together(iter(docs)):
                with steady_heap():
                    trainer.fit(group, FIRST_RATE, FIRST_LANES)
        yield pa.RecordBatch.from_arrays([pa.array([trainer.flat.tobytes()], pa.binary())], names=["params"])

    # a shard, by its definition, not the corpus: about 2 * SHARD bytes
    one = train.where("shard = 0").repartition(1).sortWithinPartitions("hash", "codes").mapInArrow(tidied(begin), "params binary").collect()
    common = gru.views(np.frombuffer(one[0]["params"], np.float32)) if one else params

    def line(part: int, tokens: int, flat: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([tokens], pa.int64()), pa.array([flat.astype("<f8").tobytes()], pa.binary())], names=["part", "tokens", "params"])

    def refit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (pair for batch in batches for pair in zip(batch.column(0).to_pylist(), documents_of(batch.column(2)), strict=True))
        for part, docs in groupby(pairs, itemgetter(0)):
            trainer, tokens = gru.Trainer(common, words.output, words.end), 0
            for group in together(d for _, d in docs):
                with steady_heap():
                    trainer.fit(group, RATE, SHARD_LANES)
                tokens += sum(map(len, group))
            yield line(part, tokens, trainer.flat)

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for part, n, data in zip(*(batch.column(c).to_pylist() for c in ("part", "tokens", "params")), strict=True):
                tokens, total = sums.get(part, (0, 0.0))
                sums[part] = tokens + n, total + n * np.frombuffer(data, "<f8")
        for part, (tokens, total) in sorted(sums.items()):
            yield line(part, tokens, total / tokens)

    shape = "part int, tokens long, params binary"
    # a given number of tasks: few bytes make much work here, so they must not be joined by size
    means = train.repartition(2 * shards, "shard").sortWithinPartitions("shard", "hash", "codes").mapInArrow(tidied(refit), shape)
    for parts in MEANS:  # parameters are summed in levels; one set reaches the driver
        groups = means.withColumn("of", F.col("part")).withColumn("part", F.col("part") % parts)
        means = groups.repartition("part").sortWithinPartitions("part", "of").drop("of").mapInArrow(tidied(mean), shape)
    found = sorted(means.collect(), key=lambda r: r["part"])
    if not found:
        return common
    total = sum(r["tokens"] for r in found)
    return gru.views(sum(r["tokens"] / total * np.frombuffer(r["params"], "<f8") for r in found).astype(np.float32))


def modelled(rows: DataFrame, words: Vocabulary, params: gru.Params) -> DataFrame:
    """The model's part of every document's score (log10), beside its other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with steady_heap():
                model = gru.score(params, words.output, documents_of(batch.column(7)), words.end) / np.log(10) + batch.column(6).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(model)], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model"])

    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "late", "codes"]
    return rows.select(*names).mapInArrow(tidied(run), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double")


def scores(docs: DataFrame, head: int = HEAD, shard: int = SHARD) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    text_batches(docs.sparkSession)
    counts = stored(counted(docs), "counts")
    words = vocabulary(counts, head)
    rows = stored(coded(docs, words), "coded")
    params = fitted(rows, words, shard)
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    n = F.coalesce("n", F.lit(0))
    found = rare.join(counts.select("word", "n"), "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(n + 0.1)).alias("rare_log"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    log_all = float(np.log10(words.tokens + 0.1 * (words.distinct + 1)))
    late = F.coalesce("rare_log", F.lit(0.0))
    # rare words' forms are in the model's part already, less the log of their counts
    return modelled(rows, words, params).join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + late - F.col("n_tokens") * F.lit(log_all)).alias("base_score"), (F.col("model") + late).alias("score"),
    )
