"""Content-addressed store of token ids.

A rolling hash over the last ids cuts each document's id stream into chunks where its low bits are zero, so equal passages give equal
chunks wherever they stand. A chunk is named by the BLAKE2b digest of its bytes and written once. A document's recipe lists its
chunks' digests and sizes; its Merkle root is taken over them. Files below the store's folder, all Parquet:

* ``written/kind=chunk``   digest, payload (little-endian ids, 2 bytes each if all ids of the chunk are below 65,536, else 4)
* ``written/kind=recipe``  as the encoders left them
* ``recipes``              in ascending doc_id order: part, doc_id, start (ids of all documents before it), n_tokens, digests, sizes, root
* ``manifest``             one row per part of the recipes: documents, ids and the Merkle root over its documents' roots

Reading checks the recipes against the manifest, at once, and every chunk against its digest. ``checksums`` combines the chunks' CRCs along
the recipes, so ids are read once and not moved between executors; ``restore`` gives the ids themselves back.

Edge cases: a null or empty text is the end id alone; rows with the same doc_id keep a recipe each, in the order of their recipes; a null doc_id comes
first; an empty table gives an empty store that reads as no rows; extra columns are not read; long documents have long recipes, no cap.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.llm.common import blocks, stored, text_batches, text_views, tidied
from skeinwork.llm.lexer import mix
from skeinwork.llm.tokens import encoder, with_end

#: Ids that the rolling hash sees, mean distance of cuts (a power of two), and the least and greatest size of a chunk.
SEEN, MEAN, LEAST, MOST = 8, 256, 32, 4096
DIGEST = 16
WRITTEN = "kind string, key binary, payload binary, doc_id long, n_tokens long, sizes array<int>"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over leaves: pairs are hashed level by level; an odd one moves up."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def cut_points(ids: np.ndarray) -> np.ndarray:
    """Where the rolling hash asks for a cut: flags by position, true if a chunk may end after it."""
    seen = mix(ids.astype(np.uint64) + np.uint64(1))
    rolled = seen.copy()
    for k in range(1, SEEN):
        rolled[k:] += seen[:-k] * np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return (mix(rolled) & np.uint64(MEAN - 1)) == 0


def chunk_ends(wanted: list[int], n: int) -> list[int]:
    """Ends of a document's chunks: wanted cuts at least LEAST apart, none longer than MOST."""
    ends, last = [], 0
    for at in [*wanted, n]:
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST or (at == n and at > last):
            ends.append(at)
            last = at
    return ends


def payload_of(ids: np.ndarray) -> bytes:
    """A chunk's bytes: the width of an id, then the ids."""
    width = 2 if not len(ids) or ids.max() < 65536 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def ids_of(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1).astype("<u4")


def encoded(docs: DataFrame, path: str, end: int = 0) -> DataFrame:
    """Rows of kind recipe (key: the chunks' digests, joined) and chunk (key: its digest); a task repeats few chunks."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        known: set[bytes] = set()
        for batch in batches:
            raw, offsets = text_views(batch.column(1))
            for i, j in blocks(offsets, 2 << 20):
                ids, bounds = with_end(*encode(raw, offsets[i : j + 1]), end)
                cuts = np.flatnonzero(cut_points(ids)) + 1
                low, high = np.searchsorted(cuts, bounds[:-1], "right"), np.searchsorted(cuts, bounds[1:], "left")
                kind, key, payload, doc, size, sizes = [], [], [], [], [], []
                for k, doc_id in enumerate(batch.column(0).slice(i, j - i).to_pylist()):
                    at, n = int(bounds[k]), int(bounds[k + 1] - bounds[k])
                    ends, last, names = chunk_ends((cuts[low[k] : high[k]] - at).tolist(), n), 0, []
                    for e in ends:
                        data = payload_of(ids[at + last : at + e])
                        names.append(name := digest(data))
                        last = e
                        if name not in known:
                            known.add(name)
                            for column, value in zip((kind, key, payload, doc, size, sizes), ("chunk", name, data, None, len(data), None), strict=True):
                                column.append(value)
                    steps = np.diff([0, *ends]).tolist()
                    for column, value in zip((kind, key, payload, doc, size, sizes), ("recipe", b"".join(names), None, doc_id, n, steps), strict=True):
                        column.append(value)
                if len(known) > 200_000:  # only saves work: repeats are also dropped after the shuffle
                    known.clear()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind, pa.string()), pa.array(key, pa.binary()), pa.array(payload, pa.binary()), pa.array(doc, pa.int64()), pa.array(size, pa.int64()), pa.array(sizes, pa.list_(pa.int32()))],
                    names=["kind", "key", "payload", "doc_id", "n_tokens", "sizes"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), WRITTEN)


def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes and the Merkle root of each one's digests."""
    for batch in batches:
        roots = [merkle([d[i : i + DIGEST] for i in range(0, len(d), DIGEST)]) for d in batch.column("digests").to_pylist()]
        yield batch.append_column("root", pa.array(roots, pa.binary()))


def parts_of(rows: DataFrame) -> DataFrame:
    """One row per part of the recipes: part, documents, ids and the Merkle root over the documents' roots."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, docs_, ids, roots = None, 0, 0, []
        for batch in batches:
            for p, n, root in zip(*(batch.column(c).to_pylist() for c in ("part", "n_tokens", "root")), strict=True):
                if part is not None and p != part:
                    yield line(part, docs_, ids, roots)
                    docs_, ids, roots = 0, 0, []
                part, docs_, ids = p, docs_ + 1, ids + n
                roots.append(root)
        if part is not None:
            yield line(part, docs_, ids, roots)

    def line(part: int, n: int, ids: int, roots: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n]), pa.array([ids]), pa.array([merkle(roots)], pa.binary())], names=["part", "documents", "ids", "root"])

    return rows.select("part", "doc_id", "n_tokens", "digests", "root").repartition("part").sortWithinPartitions("part", "doc_id", "digests").drop(
        "doc_id", "digests"
    ).mapInArrow(tidied(summed), "part int, documents long, ids long, root binary")


def write(docs: DataFrame, path: str, vocabulary: str, end: int = 0) -> None:
    """Encode every document and write the store below ``path``."""
    spark = docs.sparkSession
    rows = encoded(docs, vocabulary, end)
    # a chunk has no doc_id, so its copies (one or a few from each task) meet; recipes of equal documents do not
    copies = Window.partitionBy("kind", "key", "doc_id").orderBy(F.lit(0))
    once = rows.withColumn("__n", F.row_number().over(copies)).where("kind = 'recipe' or __n = 1").drop("__n")
    once.write.partitionBy("kind").parquet(f"{path}/written")

    found = spark.read.schema(WRITTEN).parquet(f"{path}/written").where("kind = 'recipe'").select("doc_id", "n_tokens", F.col("key").alias("digests"), "sizes")
    ordered = found.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "digests")
    ordered.withColumn("part", F.spark_partition_id()).write.parquet(f"{path}/sorted")
    found = spark.read.parquet(f"{path}/sorted")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    bases = found.groupBy("part").agg(F.sum("n_tokens").alias("__ids")).withColumn("__base", F.coalesce(F.sum("__ids").over(before), F.lit(0)))
    within = Window.partitionBy("part").orderBy("doc_id", "digests").rowsBetween(Window.unboundedPreceding, -1)
    numbered = found.withColumn("__prior", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(bases.drop("__ids"), "part")

    shape = "part int, doc_id long, start long, n_tokens long, digests binary, sizes array<int>"
    numbered.selectExpr("part", "doc_id", "__base + __prior as start", "n_tokens", "digests", "sizes").mapInArrow(tidied(rooted), f"{shape}, root binary").sortWithinPartitions(
        "part", "doc_id", "digests"
    ).write.parquet(f"{path}/recipes")

    parts_of(recipes(spark, path)).write.parquet(f"{path}/manifest")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Every stored chunk: digest, size, crc and payload; raises where a payload does not match its digest."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, payloads, sizes, crc = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], []
            for name, data in zip(names, payloads, strict=True):
                if digest(data) != name:
                    raise ValueError(f"chunk {name.hex()} is damaged")
                ids = ids_of(data)
                sizes.append(len(ids))
                crc.append(zlib.crc32(ids.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(crc, pa.int64())], names=["digest", "payload", "size", "crc"])

    text_batches(spark)
    kept = spark.read.schema(WRITTEN).parquet(f"{path}/written").where("kind = 'chunk'").select(F.col("key").alias("digest"), "payload")
    return kept.mapInArrow(tidied(verified), "digest binary, payload binary, size int, crc long")


def recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/recipes")


def each_use(rows: DataFrame) -> DataFrame:
    """One row per chunk of every recipe: part, doc_id, start, n_tokens, seq, digest."""
    digests = F.expr(f"transform(sequence(1, size(sizes)), i -> substring(digests, (i - 1) * {DIGEST} + 1, {DIGEST}))")
    return rows.select("part", "doc_id", "start", "n_tokens", F.posexplode(digests).alias("seq", "digest"))


def uses(spark: SparkSession, path: str) -> DataFrame:
    return each_use(recipes(spark, path))


#: Documents, by a hash, of which one in so many tells the common chunks; those that make more than one in COMMON of their uses, so at most COMMON;
#: and the tasks over which the uses of each are dealt.
TELLS, COMMON, SALTS = 16, 4096, 64


def common(spark: SparkSession, path: str) -> DataFrame:
    """Digests that would each bring a large share of all uses to one task of a join. Which they are has no part in any result."""
    some = recipes(spark, path).where(F.pmod(F.xxhash64("doc_id", "start"), F.lit(TELLS)) == 0)
    total = some.agg(F.sum(F.size("sizes")).alias("n")).first()["n"] or 0
    counts = each_use(some).groupBy("digest").count()
    return stored(counts.where(F.col("count") > max(total // COMMON, 16)).select("digest"), "common-chunks")


def used_chunks(spark: SparkSession, path: str, *facts: str) -> DataFrame:
    """Every use of a chunk with the chunk's ``facts`` (null where the store has no such chunk). A common chunk is there several times, its uses dealt among
    those."""
    often = F.broadcast(common(spark, path).withColumn("often", F.lit(True)))
    place = F.when(F.col("often"), F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS))).otherwise(0).cast("int")
    every = uses(spark, path).join(often, "digest", "left").withColumn("salt", place).drop("often")
    places = F.when(F.col("often"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    known = chunks(spark, path).select("digest", *facts).join(often, "digest", "left").withColumn("salt", F.explode(places)).drop("often")
    return every.join(known, ["digest", "salt"], "left").drop("salt")


#: x ** 32 mod the CRC polynomial and so on: CRCs of joined data follow from those of the parts.
POLYNOMIAL = 0xEDB88320


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the CRC-32 polynomial, bits reflected."""
    a, b = a.astype(np.uint32).copy(), b.astype(np.uint32).copy()
    out = np.zeros(len(a), np.uint32)
    for k in range(32):
        out ^= np.where(a & np.uint32(1 << (31 - k)), b, np.uint32(0))
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), b >> np.uint32(1))
    return out


def shifts(most: int) -> np.ndarray:
    """x ** (32 n) for n = 0 .. most: what n ids of four bytes after some data do to its CRC."""
    out = np.zeros(most + 1, np.uint32)
    out[0] = 1 << 31
    step = np.array([1 << 31], np.uint32)
    for _ in range(32):  # times x, 32 times
        step = np.where(step & np.uint32(1), (step >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), step >> np.uint32(1))
    done = 1
    while done <= most:  # doubling: out[done + i] = out[done] * out[i]
        power = times(out[done - 1 : done], step)[0]
        n = min(done, most + 1 - done)
        out[done : done + n] = times(out[:n], np.full(n, power, np.uint32))
        done += n
    return out


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the store's files: doc_id, start, n_tokens and CRC-32 of its ids as little-endian unsigned 32-bit integers."""
    sound(spark, path)
    found = used_chunks(spark, path, "size", "crc")
    # documents are told apart by start as well: ids may repeat, and every document has its end id
    lists = found.groupBy("part", "doc_id", "start", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("seq", "size", "crc"))).alias("parts"))
    table = shifts(MOST)

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("parts")
            bounds = parts.offsets.to_numpy()
            flat = parts.values
            size, crc = flat.field("size").to_numpy(zero_copy_only=False), flat.field("crc").to_numpy(zero_copy_only=False)
            n = np.diff(bounds)
            total, ids = np.zeros(len(n), np.uint32), np.zeros(len(n), np.int64)
            for k in range(int(n.max(initial=0))):
                row = np.flatnonzero(n > k)
                at = bounds[row] + k
                if np.isnan(crc[at].astype(float)).any():
                    raise ValueError("a recipe names a chunk that is not in the store")
                total[row] = times(total[row], table[size[at].astype(np.int64)]) ^ crc[at].astype(np.uint32)
                ids[row] += size[at].astype(np.int64)
            if (ids != batch.column("n_tokens").to_numpy()).any():
                raise ValueError("a recipe's chunks do not add up to its document")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(ids), pa.array(total.astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return lists.mapInArrow(tidied(combined), "doc_id long, start long, n_tokens long, ids_crc32 long")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """The documents' ids themselves: doc_id, start, n_tokens, ids (array of int), put together from recipes and chunks."""
    sound(spark, path)
    found = used_chunks(spark, path, "payload")
    lists = found.groupBy("part", "doc_id", "start", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("seq", "payload"))).alias("parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("parts").to_pylist()
            if any(p["payload"] is None for parts in lists for p in parts):
                raise ValueError("a recipe names a chunk that is not in the store")
            ids = [np.concatenate([ids_of(p["payload"]) for p in parts]).astype(np.int32) for parts in lists]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "n_tokens", "ids"])

    return lists.mapInArrow(tidied(joined), "doc_id long, start long, n_tokens long, ids array<int>")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """Parts whose documents, ids or root, taken anew from the recipes as read, are not the manifest's, or that only one of both has (none in a sound
    store): part, documents in the manifest, documents read."""
    rows = recipes(spark, path).select("part", "doc_id", "n_tokens", "digests", F.col("root").alias("stored"))
    anew = rows.mapInArrow(tidied(rooted), "part int, doc_id long, n_tokens long, digests binary, stored binary, root binary")
    # a document's root that is not the stored one can be no leaf of the manifest's
    leaf = F.when(F.col("root").eqNullSafe(F.col("stored")), F.col("root")).otherwise(F.concat(F.coalesce("stored", F.lit(b"")), F.lit(b"\0"), "root"))
    read = parts_of(anew.withColumn("root", leaf)).toDF("part", "documents_read", "ids_read", "root_read")
    both = read.join(spark.read.parquet(f"{path}/manifest"), "part", "full")
    return both.where("not (documents <=> documents_read and ids <=> ids_read and root <=> root_read)").select("part", "documents", "documents_read")


def sound(spark: SparkSession, path: str) -> None:
    """Raises where the recipes are not those of the manifest."""
    wrong = verify(spark, path).first()
    if wrong:
        raise ValueError(f"part {wrong.part} of the recipes is not the manifest's: {wrong.documents} documents written, {wrong.documents_read} read")
