"""Packing and the token store, against the tokenizers library used plainly."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skeinwork.llm import packing, store
from skeinwork.llm.common import scratch_path, text_views

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
PIECES = ["a", "B", "the", "~", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", "é", "İ", "ß", "1", "23", "'s", "!!", "...", "<|endoftext|>", "日本", "😀", "\x1c", "​", "́", "x" * 70, " ~ "]


def plainly(path, texts):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [np.array([*e.ids, 0], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
def test_units_give_the_ids_of_whole_texts(name):
    import pyarrow as pa

    from skeinwork.llm.tokens import Encoder, with_end

    r = random.Random(3)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    path = public_tokenizers.path(name)
    encoder = Encoder(path)
    for part in (texts[:1500], texts[1500:]):
        ids, bounds = with_end(*encoder.encode(*text_views(pa.array(part))))
        for k, want in enumerate(plainly(path, part)):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == want.tolist(), part[k]


def texts_of(prose, edges):
    return [*edges, *(prose(n, n) for n in (5, 50, 500, 1700, 9000)), prose(50, 50), prose(700, 700) + prose(500, 3)]


def test_packing(make, prose, edges):
    texts, path = texts_of(prose, edges), public_tokenizers.path(FILES[0])
    got = packing.packed_documents(make(texts), path, capacity=2048).collect()
    want = {}
    for doc, ids in enumerate(plainly(path, texts)):
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[doc, k // 2048] = (k, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    layout(got, 2048)


def layout(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_packs_tightly(seed):
    r = np.random.default_rng(seed)
    lengths = np.minimum(r.geometric(1 / (100 + 100 * seed), 3000), 1000)
    counts = np.bincount(lengths, minlength=1001)
    patterns = packing.plan(counts, 1000)
    used = np.zeros(1001, np.int64)
    for copies, bin_ in patterns:
        assert sum(bin_) <= 1000
        used += copies * np.bincount(bin_, minlength=1001)
    assert (used == counts).all()
    assert sum(c for c, _ in patterns) <= -(-lengths.sum() // 1000) * 1.02 + 1


def plain_packer(lengths, capacity):
    """Best-two-fit, one document and one bin at a time."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        one, gap = [], capacity
        for x in list(left):
            if x <= gap:
                one.append(x)
                left.remove(x)
                gap -= x
        if gap and len(one) > 1:
            wide = gap + one[-1]
            pairs = [(left[i] + y, -left[i], left[i], y) for i in range(len(left)) for y in left[i + 1 :] if left[i] + y <= wide]
            if pairs and (best := max(pairs))[0] > one[-1]:
                left += [one.pop()]
                for x in best[2:]:
                    one.append(x)
                    left.remove(x)
                left.sort(reverse=True)
        bins.append(one)
    return bins


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_that_of_a_plain_packer(seed):
    r = np.random.default_rng(seed)
    lengths = np.clip(r.geometric(1 / (4 + 2 * seed), 160), 1, 40)
    got = [bin_ for copies, bin_ in packing.plan(np.bincount(lengths, minlength=41), 40) for _ in range(copies)]
    assert [sorted(b) for b in got] == [sorted(b) for b in plain_packer(lengths.tolist(), 40)]


def test_many_of_one_length_are_ranked_in_buckets(make):
    import itertools

    path = public_tokenizers.path(FILES[0])
    parts = packing.stored(packing.pieces(make([(k, "b c " * 9) for k in range(60)] + [(k, "b") for k in range(60, 90)]), path, capacity=8), "pieces")
    one, two = (packing.pack(parts, 8, n).collect() for n in (1 << 17, 5))
    assert layout(one, 8) == layout(two, 8) and len(one) == len(two) == len({(r.sequence_id, r.offset) for r in two})
    assert all(a.length == b.length for a, b in itertools.islice(zip(sorted(one), sorted(two), strict=True), 50))


def test_two_fit_beats_greedy():
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = 1, 1, 2  # greedy: 6 + 3, then 2 + 2; with two for one: 6 + 2 + 2, then 3
    assert packing.plan(counts, 10) == [(1, [6, 2, 2]), (1, [3])]


def test_packing_ties_and_empty(make):
    path = public_tokenizers.path(FILES[0])
    same = packing.packed_documents(make([(7, "b c")] * 40 + [(None, "b c"), (None, None)]), path, capacity=8).collect()
    assert len(same) == 42
    layout(same, 8)
    assert packing.packed_documents(make([]), path).collect() == []


def test_store_round_trip(make, prose, edges, spark):
    texts, vocabulary = texts_of(prose, edges), public_tokenizers.path(FILES[1])
    docs, path = make([(900 - k, t) for k, t in enumerate(texts)]), scratch_path(spark, "store-test")
    store.write(docs, path, vocabulary)
    want, start = {}, 0
    for k, ids in reversed(list(enumerate(plainly(vocabulary, texts)))):
        want[900 - k] = (start, ids)
        start += len(ids)
    got = {r.doc_id: r for r in store.restore(spark, path).collect()}
    assert {k: (r.start, r.n_tokens) for k, r in got.items()} == {k: (s, len(ids)) for k, (s, ids) in want.items()}
    assert all(got[k].ids == ids.tolist() for k, (_, ids) in want.items())
    sums = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in store.checksums(spark, path).collect()}
    assert sums == {k: (s, len(ids), zlib.crc32(ids.tobytes())) for k, (s, ids) in want.items()}
    recipes = store.recipes(spark, path)
    assert store.verify(spark, path).count() == 0 and spark.read.parquet(f"{path}/manifest").selectExpr("sum(documents)").first()[0] == len(texts)
    digests = store.chunks(spark, path).select("digest")
    assert digests.distinct().count() == digests.count() <= recipes.selectExpr("sum(size(sizes))").first()[0]


def test_store_keeps_equal_chunks_once(make, prose, spark):
    text, path = prose(6000, 5), scratch_path(spark, "store-test")
    store.write(make([text, text, "x " + text]), path, public_tokenizers.path(FILES[1]))
    uses, kept = store.uses(spark, path).count(), store.chunks(spark, path).count()
    assert kept < 0.5 * uses


def test_store_finds_damage(make, spark):
    from pyspark.sql import functions as F

    path = scratch_path(spark, "store-test")
    store.write(make(["one two three"]), path, public_tokenizers.path(FILES[1]))
    bad = spark.read.schema(store.WRITTEN).parquet(f"{path}/written").withColumn("payload", F.when(F.col("kind") == "chunk", F.concat("payload", F.unhex(F.lit("0000")))))
    bad.write.partitionBy("kind").parquet(f"{path}-bad/written")
    with pytest.raises(Exception, match="damaged"):
        store.chunks(spark, f"{path}-bad").collect()


def test_reading_misses_a_lost_or_changed_recipe(make, prose, spark):
    from pyspark.sql import functions as F

    path = scratch_path(spark, "store-test")
    store.write(make([prose(50, k) for k in range(6)]), path, public_tokenizers.path(FILES[1]))
    recipes, rest = store.recipes(spark, path), spark.read.schema(store.WRITTEN).parquet(f"{path}/written")
    swapped = F.when(F.col("doc_id") == 3, F.lit(4)).when(F.col("doc_id") == 4, F.lit(3)).otherwise(F.col("doc_id")).cast("long")
    wrong = [recipes.where("doc_id <> 3"), recipes.where("false"), recipes.withColumn("root", F.when(F.col("doc_id") == 3, F.lit(b"x")).otherwise(F.col("root")))]
    wrong += [recipes.unionByName(recipes.where("doc_id = 3")), recipes.withColumn("doc_id", swapped), recipes.withColumn("digests", F.when(F.col("doc_id") == 3, F.reverse("digests").cast("binary")).otherwise(F.col("digests")))]
    for k, bad in enumerate(wrong):
        rest.write.partitionBy("kind").parquet(f"{path}-{k}/written")
        spark.read.parquet(f"{path}/manifest").write.parquet(f"{path}-{k}/manifest")
        bad.write.parquet(f"{path}-{k}/recipes")
        for read in (store.checksums, store.restore):
            with pytest.raises(ValueError, match="not the manifest's"):
                read(spark, f"{path}-{k}").collect()


def test_chunks_that_many_documents_use(make, prose, spark):
    """A passage in most documents is broadcast; the ids are whole, and one that is lost is missed."""
    shared, vocabulary, path = prose(900, 1), public_tokenizers.path(FILES[1]), scratch_path(spark, "store-test")
    texts = [f"{prose(40, k)} {shared}" for k in range(700)]
    store.write(make(texts), path, vocabulary)
    often = store.common(spark, path)
    assert 0 < often.count() <= store.COMMON
    want = {k: (len(ids), zlib.crc32(ids.tobytes())) for k, ids in enumerate(plainly(vocabulary, texts))}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in store.checksums(spark, path).collect()} == want
    rows = spark.read.schema(store.WRITTEN).parquet(f"{path}/written").join(often.limit(1).withColumnRenamed("digest", "key"), "key", "left_anti")
    rows.write.partitionBy("kind").parquet(f"{path}-less/written")
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{part}").write.parquet(f"{path}-less/{part}")
    for read in (store.checksums, store.restore):
        with pytest.raises(Exception, match="not in the store"):
            read(spark, f"{path}-less").collect()


def test_store_of_nothing_and_of_repeated_ids(make, spark):
    vocabulary = public_tokenizers.path(FILES[1])
    for items, n in (([], 0), ([(1, "a"), (1, "a"), (1, "b c"), (None, None)], 4)):
        path = scratch_path(spark, "store-test")
        store.write(make(items), path, vocabulary)
        assert store.checksums(spark, path).count() == n


def test_chunks_wider_than_two_bytes_and_crc_of_joined_data():
    ids = np.array([70000, 1], np.uint32)
    assert store.ids_of(store.payload_of(ids)).tolist() == [70000, 1] and len(store.payload_of(ids[1:])) == 3
    a, b = np.arange(5, dtype="<u4").tobytes(), np.arange(900, dtype="<u4").tobytes()
    table = store.shifts(1000)
    joined = store.times(np.array([zlib.crc32(a)], np.uint32), table[[900]])[0] ^ np.uint32(zlib.crc32(b))
    assert int(joined) == zlib.crc32(a + b)
