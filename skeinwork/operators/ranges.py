"""How rows are dealt over tasks: by the input's size, and for windows over all rows by ordered ranges of a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, TimestampType

#: Steps of the search for a value's range: ranges are 2 ** STEPS, cut at quantiles of the data, so that outliers don't fill one range with all the rest.
STEPS = 12

#: Bytes of the tables' files for each partition of an exchange, and the most that partitions are merged to, so that a task's share of a join or an
#: aggregation does not grow with the input.
FILE_BYTES, MERGED_BYTES = 4 << 20, 16 << 20
#: Bytes of the tables' files for each task that pairs cells: there are many times as many pairs as cells.
PAIRED_BYTES = 2 << 20


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, as the planner knows them without reading; other inputs count as none."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def dealt(spark: SparkSession, inputs: list[DataFrame]) -> None:
    """Raises the session's first number of partitions to what the inputs' size asks for; adaptive execution merges those that turn out small. It is
    never lowered, for plans made earlier may not have run yet."""
    first, merged = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    wanted = -(-sum(map(stored_bytes, inputs)) // FILE_BYTES)
    if wanted > int(spark.conf.get(first, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(first, str(wanted))
    if wanted > 1 and int(spark._jsparkSession.sessionState().conf().getConf(spark._jvm.org.apache.spark.sql.internal.SQLConf.ADVISORY_PARTITION_SIZE_IN_BYTES())) > MERGED_BYTES:
        spark.conf.set(merged, str(MERGED_BYTES))


def pieces(spark: SparkSession, inputs: list[DataFrame]) -> int:
    """Tasks that pair cells: by the inputs' size, and not fewer than the session's partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(map(stored_bytes, inputs)) // PAIRED_BYTES))


def orderable(kind: DataType) -> bool:
    """Whether a type's values can be dealt to ranges."""
    return isinstance(kind, (NumericType, DateType, TimestampType))


def as_double(value: Column, kind: DataType) -> Column:
    return value.cast("double") if isinstance(kind, NumericType) else value.cast("timestamp").cast("double")


def ranged(df: DataFrame, value: Column, name: str, down: bool = False, among: DataFrame | None = None, steps: int = STEPS) -> DataFrame:
    """``df`` with the number of each row's range, ascending (or descending) as ``value`` (a double) is, and null in the last one. Equal values share a
    range. The cuts come from a sketch of bounded size, merged from the tasks', of the rows or of those ``among`` them."""
    finite = (df if among is None else among).select(F.when(F.abs(value) < float("inf"), value).alias("__finite"))
    # as text, for thousands of literals cross to the JVM one by one otherwise
    cuts = finite.selectExpr(f"percentile_approx(__finite, array({', '.join(f'{k / 2**steps}D' for k in range(1, 2**steps))}), {2 ** (STEPS + 1)}) AS __cuts")
    last = F.lit(2**steps)
    df = df.withColumn("__value", value).crossJoin(F.broadcast(cuts)).withColumn("__at", F.lit(0))  # one row by its definition
    for k in reversed(range(steps)):  # a column a step compiles, where a lambda over the steps is interpreted row by row
        df = df.withColumn("__at", F.col("__at") + F.when(F.element_at("__cuts", F.col("__at") + 2**k) < F.col("__value"), 2**k).otherwise(0))
    number = F.when(F.col("__value").isNull(), last).otherwise(-F.col("__at") if down else F.col("__at"))
    return df.withColumn(name, number).drop("__cuts", "__value", "__at")
