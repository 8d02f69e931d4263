"""Transform nodes: filter, slice, computed dimensions and measures, ranks, order and limit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions import column, test
from skeinwork.model import RANKS, Transform, dim_name
from skeinwork.operators.ranges import as_double, orderable, ranged
from skeinwork.parse import Call, Expr, expression


def ranked(call: Call, partition: tuple[str, ...]) -> Column:
    """rank and row_number (with ``_desc``), and ntile over a measure, as longs."""
    value = column(call.args[0], F.col)
    order = value.desc_nulls_last() if call.name.endswith("_desc") else value.asc_nulls_last()
    window = Window.partitionBy(*partition).orderBy(order, *[column(a, F.col) for a in call.args[1:] if call.name.startswith("row_number")])
    if call.name == "ntile":
        return F.ntile(int(call.args[1].text)).over(Window.partitionBy(*partition).orderBy(order, *[column(a, F.col) for a in call.args[2:]])).cast("long")
    return (F.rank() if call.name.startswith("rank") else F.row_number()).over(window).cast("long")


def globally_ranked(df: DataFrame, call: Call, name: str) -> DataFrame:
    """``df`` with a rank over all its rows. One window would sort everything in one task; here rows go to ranges of the value, ranked within,
    and the rows of the ranges before are added: a range's count is all that the ranges need to know of each other."""
    value = column(call.args[0], F.col)
    value = as_double(value, df.select(value).schema[0].dataType)
    down = call.name.endswith("_desc")
    kind = call.name.removesuffix("_desc")
    more = [column(a, F.col) for a in (call.args[2:] if kind == "ntile" else call.args[1:] if kind == "row_number" else ())]
    df = ranged(df.withColumn("__v", value), F.col("__v"), "__range", down)
    whole = Window.partitionBy()
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    counts = df.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select(
        "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("__all")
    )
    window = Window.partitionBy("__range").orderBy(F.col("__v").desc_nulls_last() if down else F.col("__v").asc_nulls_last(), *more)
    place = (F.rank() if kind == "rank" else F.row_number()).over(window).cast("long") + F.col("__before")
    if kind == "ntile":
        tiles = int(call.args[1].text)
        size, rest = F.expr(f"__all div {tiles}"), F.col("__all") % tiles
        large = rest * (size + 1)
        place = F.when(place <= large, F.floor((place - 1) / (size + 1)) + 1).otherwise(rest + F.floor((place - 1 - large) / F.greatest(size, F.lit(1))) + 1).cast("long")
    return df.join(counts, "__range").withColumn(name, place).drop("__v", "__range", "__before", "__all")


def computed(e: Expr, partition: tuple[str, ...]) -> Column:
    return ranked(e, partition) if isinstance(e, Call) and e.name in RANKS else column(e, F.col)


def run(df: DataFrame, node: Transform, dims: list[str], measures: list[str]) -> DataFrame:
    """``dims`` and ``measures``: the node's names, without dimensions that an equality fixes. The filter sees the input's values."""
    df = reduce(lambda d, p: d.where(test(p, F.col)), node.condition, df)
    given = {dim_name(d): d for d in (*(node.dims if node.dims is not None else dims), *node.extract) if dim_name(d) in dims}
    out = [column(expression(given.get(d, d))[0], F.col).alias(d) for d in dims]
    if node.measures is None:
        out += [F.col(m) for m in measures]
    else:
        for text, m in zip(node.measures, measures, strict=True):
            e = expression(text)[0]
            if isinstance(e, Call) and e.name in RANKS and not node.partition and orderable(df.select(column(e.args[0], F.col)).schema[0].dataType):
                df = globally_ranked(df, e, f"__rank_{m}")
                out.append(F.col(f"__rank_{m}").alias(m))
            else:
                out.append(computed(e, node.partition).alias(m))
    df = df.select(*out)
    if node.order:
        df = df.orderBy(*order_columns(node.order))
    return df.limit(node.limit) if node.limit is not None else df


def order_columns(order: tuple[str, ...]) -> list[Column]:
    out = []
    for text in order:
        name, _, way = text.partition(" ")
        out.append(F.col(name).desc_nulls_last() if way.strip().lower() == "desc" else F.col(name).asc_nulls_last())
    return out
