"""Run chains: step by step, each node stored and timed, or as one lazy plan."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from skeinwork.model import Chain, Source
from skeinwork.plans.compiler import Compiler, read_often


@dataclass(frozen=True)
class Step:
    node: str
    rows: int
    seconds: float


def pipe(chain: Chain, spark: SparkSession, sf_dir: str, name: str | None = None, fuse: bool = True) -> DataFrame:
    """The whole chain as one plan; nothing runs before the caller's action."""
    return Compiler(chain, spark, sf_dir, fuse).frame(chain.target(name)).rows()


@contextmanager
def running(chain: Chain, spark: SparkSession, sf_dir: str, name: str | None = None) -> Iterator[DataFrame]:
    """As ``pipe``, but rows that several nodes read are kept until the block ends: the base tables are scanned far fewer times."""
    target = chain.target(name)
    compiler = Compiler(chain, spark, sf_dir, shared=read_often(chain, target))
    try:
        yield compiler.frame(target).rows()
    finally:
        compiler.release()


@contextmanager
def stepwise(chain: Chain, spark: SparkSession, sf_dir: str, name: str | None = None) -> Iterator[tuple[DataFrame, list[Step]]]:
    """Every node that the target rests on, one action each; rows that several nodes read are kept until the block ends."""
    target = chain.target(name)
    nodes = chain.needed(target)
    compiler, steps = Compiler(chain, spark, sf_dir, fuse=False, shared=read_often(chain, target)), []
    try:
        for node in nodes:
            if not isinstance(node, Source):
                began = time.time()
                rows = compiler.frame(node).rows().count()
                steps.append(Step(node.name, rows, time.time() - began))
        yield compiler.frame(target).rows(), steps
    finally:
        compiler.release()


def sorted_result(df: DataFrame, chain: Chain, name: str | None = None) -> DataFrame:
    """The default order: all dimensions of the final node, and of it only."""
    dims = chain.dims(chain.target(name))
    return df.orderBy(*dims) if dims else df


def shown(df: DataFrame, limit: int = 10) -> str:
    """Header, rule and the first rows, separated by tabs."""
    rows = df.limit(limit).collect()
    head = "\t".join(df.columns)
    return "\n".join([head, "-" * len(head.expandtabs()), *("\t".join("" if v is None else v.isoformat() if hasattr(v, "isoformat") else str(v) for v in r) for r in rows)])
