"""Combine nodes: inner joins on equal or compared dimensions, with one arithmetic result per measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import combine
from skeinwork.model import Combine


def compare(a: Column, op: str, b: Column) -> Column:
    return {"=": a.__eq__, "!=": a.__ne__, "<": a.__lt__, "<=": a.__le__, ">": a.__gt__, ">=": a.__ge__}[op](b)


def run(left: DataFrame, right: DataFrame, node: Combine, left_dims: list[str], right_dims: list[tuple[str, str]], single: bool) -> DataFrame:
    """``right_dims``: the right's dimensions that stay, and their names. ``single``: the right side has one row by its definition,
    so it may be broadcast whatever the data; any other choice of strategy is left to the optimizer."""
    a, b = left.alias("a"), right.alias("b")
    tests = [compare(F.col(f"a.{x}"), op, F.col(f"b.{y}")) for x, op, y in node.on]
    if tests:
        condition = tests[0]
        for t in tests[1:]:
            condition = condition & t
        both = a.join(b, condition, "inner")
    else:
        both = a.crossJoin(F.broadcast(b) if single else b)
    sides = lambda m, side: F.col(f"{side}.{m}") if m else F.lit(None)
    measures = [combine(sides(x, "a"), op, sides(y, "b")).alias(f"m{k}") for k, (x, op, y) in enumerate(node.measures)]
    return both.select(*[F.col(f"a.{d}").alias(d) for d in left_dims], *[F.col(f"b.{d}").alias(new) for d, new in right_dims], *measures)
