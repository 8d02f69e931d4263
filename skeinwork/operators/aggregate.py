"""Aggregate nodes: grouping, distinct rows, quantiles, and rolling windows that cross group borders."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from skeinwork.functions import column, quantile_share, test
from skeinwork.model import AGGREGATES, ROLLING, Aggregate
from skeinwork.operators.ranges import as_double, orderable, ranged
from skeinwork.operators.transform import globally_ranked
from skeinwork.parse import Call, Expr, Name, Number, Star


def argument(call: Call) -> Expr:
    return call.args[0]


def filtered(df: DataFrame, node: Aggregate) -> DataFrame:
    return reduce(lambda d, p: d.where(test(p, F.col)), node.condition, df)


def measure(call: Expr) -> Column:
    """An aggregate as a column; quantiles by neighbours are made in ``grouped``."""
    if not isinstance(call, Call) or call.name not in AGGREGATES:
        raise ValueError(f"not an aggregate: {call}")
    arg = argument(call)
    if call.name == "count":
        if isinstance(arg, Star):
            return F.count(F.lit(1))
        return F.count_distinct(column(arg, F.col)) if call.distinct else F.count(column(arg, F.col))
    c = column(arg, F.col)
    match call.name:
        case "sum" | "avg":
            return getattr(F, call.name)(c.cast("double"))
        case "raw":
            return F.any_value(c)
        case "max" | "min":
            return getattr(F, call.name)(c)
    return F.percentile(c, quantile_share(call))


def grouped(df: DataFrame, dims: list[str], calls: list[Expr], names: list[str]) -> DataFrame:
    """``df`` is filtered. Measures get ``names``."""
    if not calls:
        return df.select(*dims).distinct()
    # within groups Spark's own percentile interpolates; over all rows it would count every distinct value in one task
    quantiles = [c for c in dict.fromkeys(calls) if isinstance(c, Call) and c.name.startswith("quantile") and (c.name != "quantile_cont" or not dims)]
    weighted: dict[Call, str] = {}
    for k, call in enumerate(quantiles):
        # neighbours by row number: a window sorts with spilling, whatever the group's size
        value = column(argument(call), F.col)
        if dims:
            group = Window.partitionBy(*dims)
            row, size = F.row_number().over(group.orderBy(value.asc_nulls_last())), F.count(value).over(group)
        else:  # over all rows: places are ranks, dealt over ranges; the count is one row
            sizes = df.agg(F.count(value).alias(f"__size{k}"))
            df = globally_ranked(df, Call("row_number", (argument(call),)), f"__row{k}").crossJoin(F.broadcast(sizes))
            row, size = F.col(f"__row{k}"), F.col(f"__size{k}")
        share = quantile_share(call)
        if call.name in ("quantile_weibull", "quantile_cont"):
            place = F.lit(share) * (size - 1) + 1 if call.name == "quantile_cont" else F.least(F.greatest(F.lit(share) * (size + 1), F.lit(1.0)), size.cast("double"))
            low = F.floor(place)
            part = F.when(row == low, F.when(place == low, value).otherwise((low + 1 - place) * value)).when((row == low + 1) & (place > low), (place - low) * value)
        else:
            part = F.when(row == F.greatest(F.lit(1), F.ceil(F.lit(share) * size)), value)
        weighted[call] = f"__q{k}"
        df = df.withColumn(weighted[call], part)
    out = []
    for call, name in zip(calls, names, strict=True):
        if call in weighted:
            c = F.sum(weighted[call]) if call.name in ("quantile_weibull", "quantile_cont") else F.max(weighted[call])
        else:
            c = measure(call)
        out.append(c.alias(name))
    return df.groupBy(*dims).agg(*out) if dims else df.agg(*out)


def dealt(df: DataFrame, dims: list[str], calls: list[Call], by: str) -> tuple[DataFrame, list[Call]]:
    """``df`` dealt to tasks by a dimension, with the arguments of aggregates computed before, and the aggregates over them."""
    names = {a: f"__x{k}" for k, a in enumerate(dict.fromkeys(argument(c) for c in calls if not isinstance(argument(c), Star)))}
    df = df.select(*dims, *[column(a, F.col).alias(n) for a, n in names.items()]).repartition(by)
    return df, [c if isinstance(argument(c), Star) else replace(c, args=(Name(names[argument(c)]), *c.args[1:])) for c in calls]


def rolled(df: DataFrame, dims: list[str], partition: tuple[str, ...], calls: list[Expr], names: list[str]) -> DataFrame:
    """Rolling functions over the rows in the order of all dims; without ``partition`` frames cross group borders.

    An unpartitioned window would bring all rows to one task. Instead the first dim's values, or ranges of them, are the partitions, and each gets a
    halo: the last n rows before it. Those are found among the last n rows of every partition, few rows that may be sorted together.
    """
    widths = [int(c.args[1].text) if len(c.args) > 1 and isinstance(c.args[1], Number) else 1 for c in calls]
    order = [F.col(d).asc_nulls_last() for d in dims]
    halo = not partition and (len(dims) > 1 or orderable(df.schema[dims[0]].dataType))
    if halo:
        df = with_halo(df, dims, max(widths))
    window = Window.partitionBy(*(["__group"] if halo else partition)).orderBy(*order)
    out = []
    for call, width, name in zip(calls, widths, names, strict=True):
        c = column(argument(call), F.col)
        kind = ROLLING[call.name]
        out.append(getattr(F, kind)(c.cast("double") if kind in ("sum", "avg") else c).over(window.rowsBetween(-width, 0)).alias(f"__{name}"))
    own = F.col("__own") if halo else F.lit(True)
    return df.select(*dims, own.alias("__own"), *out).where("__own").select(*dims, *[F.col(f"__{n}").alias(n) for n in names])


def with_halo(df: DataFrame, dims: list[str], most: int) -> DataFrame:
    """``df`` with, for each group, copies of the ``most`` rows before it; __own tells rows from copies, __group the group served. A group is a value of
    the first dim if that is a date or a text, and a range of its values if it is a number or a time, which may be of as many values as rows."""
    names, kind = df.columns, df.schema[dims[0]].dataType
    if orderable(kind) and (len(dims) == 1 or not isinstance(kind, DateType)):
        df = ranged(df, as_double(F.col(dims[0]), kind), "__part")
    else:
        df = df.withColumn("__part", F.col(dims[0]))
    order = [F.col(d).asc_nulls_last() for d in dims]
    back = [F.col(d).desc_nulls_first() for d in dims]
    tails = df.withColumn("__r", F.row_number().over(Window.partitionBy("__part").orderBy(*back))).where(F.col("__r") <= most).drop("__r")
    tails = tails.withColumn("__i", F.row_number().over(Window.orderBy(*order)))
    groups = tails.groupBy(F.col("__part").alias("__g")).agg(F.min("__i").alias("__from"))
    wanted = groups.where("__from > 1").select("__g", F.explode(F.sequence(F.greatest(F.lit(1), F.col("__from") - most), F.col("__from") - 1)).alias("__i"))
    halo = tails.join(wanted, "__i").select(*names, F.col("__g").alias("__group"), F.lit(False).alias("__own"))
    return df.select(*names, F.col("__part").alias("__group"), F.lit(True).alias("__own")).unionByName(halo)
