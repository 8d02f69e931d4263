"""Sums of products over the pairs of cells that share a group, such as the items of one customer.

The pairs are far more than the cells. Joined and then summed by pair, all of them go through an exchange, and again through one for each later join on
either item. Here they go through none. Items are dealt to blocks, ordered ranges of their values where they have an order; a group's cells are an array,
sorted by block and item, and go to each block that they touch once, from the block's first cell on. There each cell of the block is paired with those from
itself on. A block is read by several tasks, each for its share of the items, so that a task's sums don't grow with the block. The half with the larger
item first is the mirrored other half. What later joins bring by item is attached to the cells before.

What is moved is a copy of a group's cells for each block that they touch: few where groups hold items near each other, and at most half a group for each
of its cells, as many as there are half pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.ranges import STEPS, as_double, orderable, ranged

#: The most tasks that read a block, each for its share of the block's items. Each is a branch of the plan, which the driver holds.
TURNS = 8


def shares(tasks: int) -> tuple[int, int]:
    """The number of blocks, and of the tasks that read each."""
    blocks = min(-(-tasks // TURNS), 2**STEPS)
    return blocks, min(-(-tasks // blocks), TURNS)


def attached(cells: DataFrame, item: str, right: DataFrame, dim: str, names: dict[str, str], found: str | None) -> DataFrame:
    """``cells`` with measures of ``right``, at most one row per item, under the given names. Without a match a cell is dropped, or, if ``found`` names
    a column for that, has null there."""
    by = right.select(F.col(dim).alias("__item"), *[F.col(m).alias(new) for m, new in names.items()], *([F.lit(True).alias(found)] if found else []))
    return cells.join(by, F.col(item) == F.col("__item"), "left" if found else "inner").drop("__item")


def blocked(cells: DataFrame, item: str, value: str, blocks: int) -> DataFrame:
    """``cells`` with the number of their item's block. The cuts come from the cells that have a value, so that they read the same exchange as all cells."""
    kind = cells.schema[item].dataType
    if blocks == 1:
        return cells.withColumn("__block", F.lit(0))
    if not orderable(kind):
        return cells.withColumn("__block", F.pmod(F.hash(item), F.lit(blocks)))
    steps = min((blocks - 1).bit_length() + 3, STEPS)  # each turn's branch repeats them
    at = ranged(cells, as_double(F.col(item), kind), "__range", among=cells.where(F.col(value).isNotNull()), steps=steps)
    return at.withColumn("__block", F.least(F.floor(F.col("__range") * blocks / 2**steps), F.lit(blocks - 1)).cast("int")).drop("__range")


def tails(cells: DataFrame, by: list[str], fields: list[str], blocks: int) -> DataFrame:
    """Rows (block, own, all0, all1, ...) of cells that are ``blocked``, in their block's partition: for each group and each block that it touches, the
    group's cells from the block's first one on, an array for each of ``fields``, of which the first is the item. The first ``own`` cells are the block's."""
    known = cells
    for d in by:
        known = known.where(F.col(d).isNotNull())
    # the order of blocks and items is the same in all groups, so a pair has the same first item in all of them
    cell = F.struct(F.col("__block"), *[F.col(f).alias(f"f{k}") for k, f in enumerate(fields)])
    # moved as they are: collected before the exchange, hardly any two of a group would meet, and each would take more bytes
    groups = known.select(*by, "__block", *fields).repartition(*by).groupBy(*by).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    groups = groups.select(F.col("cells.__block").alias("of"), *[F.col(f"cells.f{k}").alias(f"all{k}") for k in range(len(fields))])
    return groups.select("*", F.explode(F.array_distinct("of")).alias("block")).withColumn("at", F.array_position("of", F.col("block")).cast("int")).select(
        "block", (F.size("of") - F.size(F.array_remove("of", F.col("block")))).alias("own"),
        *[F.slice(f"all{k}", F.col("at"), F.size("all0") - F.col("at") + 1).alias(f"all{k}") for k in range(len(fields))],
    ).repartitionById(max(blocks, 2), "block")  # a union of single partitions would be one task


def summed(cells: DataFrame, by: list[str], item: str, value: str, kept: list[str], blocks: int, turns: int) -> DataFrame:
    """Rows (a, b, sum, a0, a1, ..., b0, b1, ...) of cells that are ``blocked``: for every ordered pair of items that meet in a group, the sum of the
    products of their values, and the ``kept`` columns of either, which are the same for all cells of an item. An item has at most one cell in a group."""
    fields = [item, value, *kept]
    dealt = tails(cells, by, fields, blocks)
    return reduce(DataFrame.union, [turn(dealt, len(fields), k, turns) for k in range(turns)])


def turn(dealt: DataFrame, fields: int, number: int, turns: int) -> DataFrame:
    """The sums for one share of each block's items."""
    own = dealt.select("*", F.posexplode(F.slice("all0", F.lit(1), F.col("own"))).alias("at", "p0")).where(F.pmod(F.xxhash64("p0"), F.lit(turns)) == number)
    pairs = own.select("*", F.posexplode(F.slice("all0", F.col("at") + 1, F.size("all0") - F.col("at"))).alias("next", "q0")).select(
        "block", "p0", "q0", *[F.get(f"all{k}", F.col("at")).alias(f"p{k}") for k in range(1, fields)],
        *[F.get(f"all{k}", F.col("at") + F.col("next")).alias(f"q{k}") for k in range(1, fields)],
    )
    numbers = range(2, fields)
    # an item has one block, which is named for the optimizer: rows are dealt by it
    sums = pairs.groupBy("block", "p0", "q0").agg(
        F.sum((F.col("p1") * F.col("q1")).cast("double")).alias("sum"), *[F.max(f"{side}{k}").alias(f"{side}{k}") for side in "pq" for k in numbers]
    )
    ways = F.when(F.col("p0").eqNullSafe(F.col("q0")), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    either = lambda one, other: F.when(F.col("turned"), F.col(other)).otherwise(F.col(one))
    return sums.select("*", F.explode(ways).alias("turned")).select(
        either("p0", "q0").alias("a"), either("q0", "p0").alias("b"), "sum",
        *[either(f"p{k}", f"q{k}").alias(f"a{k - 2}") for k in numbers], *[either(f"q{k}", f"p{k}").alias(f"b{k - 2}") for k in numbers],
    )
