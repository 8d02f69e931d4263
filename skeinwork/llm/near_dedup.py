"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

Documents with equal shingle sets form a class, and only classes go on. A class has a signature of 52 symbols of 16 bits. Cut into 13 chunks of
four, any two signatures at a distance of at most 25 agree in all or three symbols of some chunk; so a key for every chunk and every
choice of the symbol that may differ finds all pairs within that distance (at a similarity of 0.8 the expected distance is 10.4, and
one pair in about two million exceeds 25; none of lower distance is lost). What the keys bring together is confirmed on full sets:

1. In each bucket (equal key) every member is compared with the smallest id: one pair per member, not all pairs. Confirmed pairs give
   first components.
2. Members of different components that share a bucket are still open. Those outside the bucket's leading component meet one another and the
   leading component's members in blocks of bounded size (its own members need not meet), where signatures tell which members have a
   candidate in another component; the blocks keep those members, one row each.
3. The full sets come to those blocks, and candidates are confirmed there. One link between a member and a component is enough: more
   would not change the components. So groups of thousands of near copies give thousands of rows, not a row per pair, and no link
   between components is missed.

Edge cases: null texts and texts without words have no shingles, are linked with nothing and are kept; texts of fewer words than a shingle have
the whole sequence as one; rows that repeat a doc_id count as one document: of different
texts the one with words whose set's name is least stands for it, and each row keeps the size of its own set; a null doc_id is linked with nothing and kept; an
empty table gives an empty result; long texts are hashed whole; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import blocks, joined_evenly, stored, text_batches, text_views, tidied
from skeinwork.llm.components import components
from skeinwork.llm.lexer import lex
from skeinwork.llm.shingles import RADIUS, SYMBOLS, chunk_keys, first_shared_key, set_names, shingle_sets, signatures

#: A larger bucket is cut into parts of about so many members, and every two parts meet as a block.
BLOCK_ROWS = 256
#: Pairs of signatures that are compared in one array operation.
PAIRS = 1 << 15
SIGNED = "doc_id long, n_shingles long, s1 long, s2 long, signature binary"


def ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def signed(docs: DataFrame, width: int) -> DataFrame:
    """Per document: size and name of its shingle set, and its signature."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_views(batch.column(1))
            for i, j in blocks(offsets):
                sets, bounds = shingle_sets(lex(raw, offsets[i : j + 1]), width)
                s1, s2 = set_names(sets, bounds)
                symbols = signatures(sets, bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(bounds)), pa.array(s1), pa.array(s2), pa.array([x.tobytes() for x in symbols], pa.binary())],
                    names=["doc_id", "n_shingles", "s1", "s2", "signature"],
                )

    return ids_and_texts(docs).mapInArrow(tidied(run), SIGNED)


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """Sorted shingle hashes of the documents named in ``ids``: id, shingles (binary); of several texts with words those of the least name, as in ``once``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_views(batch.column(1))
            for i, j in blocks(offsets):
                sets, bounds = shingle_sets(lex(raw, offsets[i : j + 1]), width)
                s1, s2 = set_names(sets, bounds)
                parts = [sets[bounds[k] : bounds[k + 1]].tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(s1), pa.array(s2), pa.array(parts, pa.binary())], names=["id", "s1", "s2", "shingles"])

    rows = ids_and_texts(docs).join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    found = rows.mapInArrow(tidied(run), "id long, s1 long, s2 long, shingles binary").where(F.length("shingles") > 0)
    return found.groupBy("id").agg(F.min_by("shingles", F.struct("s1", "s2")).alias("shingles"))


def symbols_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def alike(size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether two sets' sizes allow the similarity."""
    return 100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)


def near_pairs(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sizes and signatures allow a link."""
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = alike(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), percent)
                ok &= (symbols_of(batch.column("s_a")) != symbols_of(batch.column("s_b"))).sum(axis=1) <= RADIUS
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(tidied(run), "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that are linked, by their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(tidied(run), "a long, b long")


def bucketed(reps: DataFrame) -> DataFrame:
    """Keys that several classes share, with each class of such a key: key, id, members, least (id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = chunk_keys(symbols_of(batch.column("signature"))) if batch.num_rows else np.zeros((0, SYMBOLS), np.uint64)
            ids = np.repeat(batch.column("id").to_numpy(), SYMBOLS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["key", "id"])

    keys = reps.select("id", "signature").mapInArrow(tidied(run), "key long, id long")
    shared = keys.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("least")).where("members > 1")
    return keys.join(shared, "key")


def open_blocks(buckets: DataFrame, reps: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Blocks of buckets of several components: key, lo, hi, mine (the member's part of its bucket), id; members without a candidate are left out.

    Of a bucket the members outside its leading component have parts 0 .. few - 1, those of the leading one few .. few + many - 1. Every two parts of
    the first kind meet, and each of these meets each of the second kind: a bucket with few stray members costs about a row a member.
    """
    placed = buckets.select("key", "id").join(labels, "id")
    counted = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = counted.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1").select(
        "key", F.col("top.component").alias("leading"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK_ROWS).cast("int").alias("few"), F.ceil(F.col("top.n") / BLOCK_ROWS).cast("int").alias("many")
    )
    rows = placed.join(mixed, "key").join(reps.select("id", "n", "signature"), "id")
    stray, h = F.col("component") != F.col("leading"), F.xxhash64("id")
    rows = rows.withColumn("mine", F.when(stray, F.pmod(h, F.col("few"))).otherwise(F.col("few") + F.pmod(h, F.col("many"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("few") - 1 + F.when(stray, F.col("many")).otherwise(0))))
    rows = rows.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "id", "component", "n", "signature")
    names = ["key", "lo", "hi", "mine", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in by_group(batches, ("key", "lo", "hi")):
            a, b = candidates(block, percent)
            if len(a):
                yield from block.select(names).take(pa.array(np.union1d(a, b))).combine_chunks().to_batches()

    return dealt(rows).mapInArrow(tidied(run), "key long, lo int, hi int, mine int, id long")


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def by_group(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal ``names``, of rows that come sorted by them."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        if not table.num_rows:
            continue
        values = [table.column(n).to_numpy() for n in names]
        new = np.zeros(table.num_rows, bool)
        for v in values:
            new[1:] |= v[1:] != v[:-1]
        cuts = np.flatnonzero(new).tolist()
        for a, b in zip([0, *cuts], cuts, strict=False):
            yield table.slice(a, b - a)
        rest = table.slice(cuts[-1] if cuts else 0).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def candidates(block: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with near signatures that meet first under this key: a member of the component with fewer members in the block, and one of the other."""
    component = block.column("component").to_numpy()
    none = np.zeros(0, np.int64)
    if (component == component[0]).all():
        return none, none
    size, mine = (block.column(c).to_numpy() for c in ("n", "mine"))
    _, back, members = np.unique(component, return_inverse=True, return_counts=True)
    strength = members[back]
    symbols = symbols_of(block.column("signature").combine_chunks())
    column = block.column("key")[0].as_py() & 63
    apart = block.column("lo")[0].as_py() != block.column("hi")[0].as_py()
    n, found = len(size), []
    rows = max(1, PAIRS // n)
    for k in range(0, n, rows):  # some rows against all later ones at a time
        a, b = np.nonzero(np.arange(k, min(k + rows, n))[:, None] < np.arange(n)[None, :])
        a += k
        ok = (component[a] != component[b]) & alike(size[a], size[b], percent)
        if apart:  # pairs within one part are met where lo equals hi
            ok &= mine[a] != mine[b]
        a, b = a[ok], b[ok]
        near = (symbols[a] != symbols[b]).sum(axis=1) <= RADIUS
        a, b = a[near], b[near]
        first = first_shared_key(symbols[a], symbols[b]) == column
        a, b = a[first], b[first]
        smaller = (strength[a] < strength[b]) | ((strength[a] == strength[b]) & (component[a] > component[b]))
        found.append((np.where(smaller, a, b), np.where(smaller, b, a)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def late_links(open_rows: DataFrame, reps: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) in open blocks: at most one for a member and a component that it is held against."""
    rows = open_rows.join(reps.select("id", "n", "signature"), "id").join(labels, "id").join(sets, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in by_group(batches, ("key", "lo", "hi")):
            links = confirmed_links(block, percent)
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt(rows).mapInArrow(tidied(run), "a long, b long").distinct()


def confirmed_links(block: pa.Table, percent: int) -> list[tuple[int, int]]:
    a, b = candidates(block, percent)
    if not len(a):
        return []
    ids, component, sizes = (block.column(c).to_numpy() for c in ("id", "component", "n"))
    shingles = block.column("shingles")
    sets = {int(k): np.frombuffer(shingles[int(k)].as_py(), np.uint64) for k in np.union1d(a, b)}
    out = []
    order = np.lexsort((b, component[b], a))
    a, b = a[order], b[order]
    starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    for first, last in zip(starts, np.append(starts[1:], len(a)), strict=True):
        mine, others = sets[int(a[first])], b[first:last]
        flat = np.concatenate([sets[int(k)] for k in others])
        hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
        both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes[others]) - sizes[others])
        linked = others[100 * both >= percent * (len(mine) + sizes[others] - both)]
        _, one = np.unique(component[linked], return_index=True)  # one link to a component is enough
        out += [(int(ids[a[first]]), int(ids[k])) for k in linked[one]]
    return out


def once(signs: DataFrame) -> DataFrame:
    """One row for each doc_id that has a text with words: doc_id, s1, s2, n_shingles, signature, those of the least name."""
    least = signs.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("s1", "s2", "n_shingles", "signature")).alias("x"))
    return least.select("doc_id", "x.*")


def groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    signs = stored(signed(docs, width), "signatures")
    single = stored(once(signs), "documents")
    name = ["s1", "s2", "n_shingles"]
    classes = stored(single.groupBy(*name).agg(F.min("doc_id").alias("id"), F.min("signature").alias("signature"), F.count("*").alias("members")), "classes")
    reps = classes.select("id", F.col("n_shingles").alias("n"), "signature")
    buckets = stored(bucketed(reps), "buckets")
    sets = stored(full_sets(docs, buckets.select("id").distinct(), width), "sets")

    stars = buckets.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    links = stored(confirmed(near_pairs(stars, reps, percent), sets, percent), "links")
    first = components(links)
    labels = stored(
        buckets.select("id").distinct().join(first, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "labels"
    )
    late = late_links(stored(open_blocks(buckets, reps, labels, percent), "open"), reps, labels, sets, percent)
    joined = components(labels.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(late))

    named = stored(classes.join(joined, "id", "left").select(*name, "members", F.coalesce("component", "id").alias("component_id")), "named")
    total = named.agg(F.sum("members").alias("n")).first()["n"] or 0
    found = joined_evenly(single.drop("signature"), named, name, "members", total).select("doc_id", "component_id")
    # rows without words or id, which may be many, meet nothing
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    result = lambda df, c: df.select("doc_id", "n_shingles", c.alias("component_id"), F.col("doc_id").eqNullSafe(c).alias("kept"))
    return result(signs.where(~alone).join(found, "doc_id"), F.col("component_id")).unionByName(result(signs.where(alone), F.col("doc_id")))


def kept_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without those that have a near duplicate with a smaller id in their group."""
    gone = groups(docs, width, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
