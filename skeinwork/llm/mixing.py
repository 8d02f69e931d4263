"""Mixing sources to target weights with DataFrame operations only.

Documents get hash-random keys; the keys' leading bits are ranges (buckets), so the sort within a source is dealt over many
tasks. Prefix sums of sizes come in two levels: over a source's bucket totals, then within a bucket. Each source is cut at
its exact budget in words; a budget above the source's size repeats whole epochs first.

Edge cases: a null or empty text has size 0 and takes nothing; a null source is a source of its own, sorted last; rows equal in
key, id and text are interchangeable; an empty table gives an empty result; other columns, whatever their names, are left alone: a document's own
columns travel in a struct. Keys depend on the seed and the id alone (on the text where the id is null), so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.llm.common import stored

#: Key ranges a source is dealt into. A range of a source with 10**9 documents holds about 250,000 of them.
BUCKETS = 4096
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def keyed(docs: DataFrame, keep: list[str], seed: int, buckets: int) -> DataFrame:
    """__row: a struct of the document's ``keep`` columns; and what places the document: __source, __bucket, __key, __doc, __tie, __size."""
    own = {name: F.col(f"`{name}`") for name in {*keep, "doc_id", "source", "text"}}
    text = own["text"].cast("string")
    name = F.coalesce(own["doc_id"].cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    source = own["source"]
    return docs.select(
        F.struct(*[own[c].alias(c) for c in keep]).alias("__row"), F.md5(F.concat(F.lit(f"{seed}:"), name)).alias("__key"),
        # a name without null, which sorts as the source does: windows and joins by it then share one partitioning
        F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string"))).alias("__source"),
        own["doc_id"].alias("__doc"), F.xxhash64(text).alias("__tie"), word_count(text).alias("__size"),
    ).withColumn("__bucket", F.shiftright(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") * F.lit(buckets), 32).cast("int"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``sources``: one row a source (__source, __total). Adds __target and __budget (words to take).

    Water filling: sources whose share exceeds ``most`` times their size are held there, in the order of size / weight, and the
    rest share what is left by weight. Only sources, never documents, meet in the unpartitioned windows.
    """
    by_name = Window.orderBy("__source")
    whole = Window.partitionBy()
    dec = lambda c: F.col(c).cast("decimal(20,0)")
    at = sources.withColumn("__n", F.row_number().over(by_name)).withColumn(
        "__w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("__n") - 1) % len(weights)) + 1).cast("long")
    ).withColumn("__cap", F.col("__total") * most)
    before = Window.orderBy(F.col("__cap") / F.col("__w"), "__n").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumns({
        "__all": F.sum("__total").over(whole), "__all_w": F.sum("__w").over(whole),
        "__caps": F.coalesce(F.sum("__cap").over(before), F.lit(0)), "__ws": F.coalesce(F.sum("__w").over(before), F.lit(0)),
    })
    left, weight = F.col("__all") - F.col("__caps"), F.col("__all_w") - F.col("__ws")
    at = at.withColumn("__held", left.cast("decimal(20,0)") * F.col("__w").cast("decimal(10,0)") > dec("__cap") * weight.cast("decimal(10,0)"))
    held = lambda c: F.sum(F.when(F.col("__held"), F.col(c)).otherwise(F.lit(0))).over(whole)
    at = at.withColumns({"__rest": F.col("__all") - held("__cap"), "__rest_w": F.col("__all_w") - held("__w")})
    share = (F.col("__rest") * F.col("__w")).cast("double") / F.greatest(F.col("__rest_w"), F.lit(1)).cast("double")
    at = at.withColumn("__target", F.when(F.col("__held"), F.col("__cap").cast("double")).otherwise(share))
    budget = F.least(F.floor(F.col("__target") + 0.5).cast("long"), F.col("__cap"))
    return at.select("__source", "__total", "__target", budget.alias("__budget"))


def shares(docs: DataFrame, keep: list[str], seed: int, buckets: int) -> DataFrame:
    """Per document: __row (its ``keep`` columns), __size, __total and __target (its source's), __epochs (whole copies), __part (words of a started one)."""
    rows = keyed(docs, keep, seed, buckets)
    # read twice below, so stored: a few thousand rows a source, against another scan of all texts
    totals = stored(rows.groupBy("__source", "__bucket").agg(F.sum("__size").alias("__sum")), "source-totals")
    sources = targets(totals.groupBy("__source").agg(F.sum("__sum").alias("__total")))
    earlier = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("__base", F.coalesce(F.sum("__sum").over(earlier), F.lit(0))).drop("__sum").join(sources, "__source")

    within = Window.partitionBy("__source", "__bucket").orderBy("__key", "__doc", "__size", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    both = rows.withColumn("__prior", F.coalesce(F.sum("__size").over(within), F.lit(0))).join(starts, ["__source", "__bucket"])
    epochs = F.when(F.col("__total") > 0, F.expr("__budget div __total")).otherwise(F.lit(0)).cast("long")
    over = F.col("__budget") - epochs * F.col("__total") - F.col("__base") - F.col("__prior")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("__size"), over))
    return both.select("__row", "__size", "__total", "__target", epochs.alias("__epochs"), part.alias("__part"))


def mix(docs: DataFrame, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    return shares(docs, ["doc_id"], seed, buckets).select(
        F.col("__row.doc_id").alias("doc_id"), F.col("__size").alias("size"), F.col("__total").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__epochs") * F.col("__size") + F.col("__part")).alias("taken"),
    )


def head_words(text: Column, n: Column) -> Column:
    """The start of a text, to the end of its n-th word, with its own white space."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, 1, n.cast("int")), "")


def mixed_documents(docs: DataFrame, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row for each whole epoch, and one, cut at the budget, for a started epoch."""
    names, part, text = docs.columns, F.col("__part"), F.col("__row.text")
    cut = F.when(part == F.col("__size"), text).otherwise(head_words(text, part))
    copies = F.concat(F.array_repeat(text, F.col("__epochs").cast("int")), F.when(part > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    out = shares(docs, names, seed, buckets).where("__size > 0 and (__epochs > 0 or __part > 0)").select("__row", F.explode(copies).alias("__text"))
    new = {"text": F.col("__text")} | ({"n_chars": F.length("__text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return out.select(*[new.get(c, F.col("__row")[c]).alias(c) for c in names])
