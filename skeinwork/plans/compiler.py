"""Compile a chain: every node once, to a lazy DataFrame.

Fusion: aggregates of the same input, dimensions and condition are one aggregation, and nodes that are computed row by row from it (joins
of two such nodes on all their dimensions, arithmetic without a filter) are expressions over its rows, so neither a second scan nor a
join is planned. What a join would drop, rows with a null dimension, is filtered instead.

Pairs: a sum of products by pair, over a join of a fused node with itself, is left open, as what later joins bring by one item of the pair is attached
to the cells before they are paired (``operators/pairs.py``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import column, combine
from skeinwork.model import RANKS, Aggregate, Chain, Combine, Node, Source, Transform
from skeinwork.operators import aggregate, pairs, transform
from skeinwork.operators import combine as joining
from skeinwork.operators.ranges import dealt, pieces
from skeinwork.parse import Call, Name, expression


@dataclass(frozen=True)
class Frame:
    """A node's rows: ``df`` with expressions over it. ``family`` names the fused aggregation that the rows still are, one for one."""

    df: DataFrame
    dims: tuple[str, ...]
    measures: tuple[Column, ...]
    family: tuple | None = None
    present: bool = False  # rows with a null dimension are out

    def rows(self) -> DataFrame:
        if self.family is None:
            return self.df
        df = self.df.dropna(subset=list(self.dims)) if self.present and self.dims else self.df
        return df.select(*self.dims, *[m.alias(f"m{k}") for k, m in enumerate(self.measures)])


@dataclass(frozen=True)
class Paired:
    """Sums of products over pairs of cells, not computed yet. ``joins``: later joins by one item of the pair, as (its place in ``dims``, the right node's
    name, its rows, its dimension, its measures); ``measures`` make the node's measures of the sum and the columns that they bring."""

    cells: DataFrame
    by: tuple[str, ...]
    item: str
    value: str
    dims: tuple[str, str]
    tasks: int
    measures: tuple[Callable[[dict[str, Column]], Column], ...]
    joins: tuple[tuple[int, str, DataFrame, str, tuple[str, ...]], ...] = ()
    family: None = None

    def rows(self) -> DataFrame:
        cells, kept, place = self.cells, [], {}
        joined = {name: {j[0] for j in self.joins if j[1] == name} for name in dict.fromkeys(j[1] for j in self.joins)}
        if any(len(sides) == 2 for sides in joined.values()):  # such a join drops null items; said here, the search for cuts reads the exchange of all others
            cells = cells.where(F.col(self.item).isNotNull())
        # dealt to blocks first: the search for cuts then reads nothing of what is attached
        blocks, turns = pairs.shares(self.tasks)
        cells = pairs.blocked(cells, self.item, self.value, blocks)
        for name, df, dim, measures in dict.fromkeys(j[1:] for j in self.joins):
            sides = joined[name]
            columns = {m: f"__{name}_{m}" for m in measures}
            found = None if len(sides) == 2 else f"__{name}"
            cells = pairs.attached(cells, self.item, df, dim, columns, found)
            for column in [*columns.values(), *([found] if found else [])]:
                place[column] = len(kept)
                kept.append(column)
        df = pairs.summed(cells, list(self.by), self.item, self.value, kept, blocks, turns)
        known = {"sum": F.col("sum")} | {f"{'ab'[j[0]]}.{j[1]}.{m}": F.col(f"{'ab'[j[0]]}{place[f'__{j[1]}_{m}']}") for j in self.joins for m in j[4]}
        for side, name, *_ in self.joins:
            if f"__{name}" in place:
                df = df.where(F.col(f"{'ab'[side]}{place[f'__{name}']}").isNotNull())
        return df.select(F.col("a").alias(self.dims[0]), F.col("b").alias(self.dims[1]), *[m(known).alias(f"m{k}") for k, m in enumerate(self.measures)])


class Compiler:
    """``shared``: names of nodes whose rows are kept when first computed, in memory or on disk, because several others read them:
    the optimizer reuses exchanges only where the plans below are equal, and pruning makes them differ."""

    def __init__(self, chain: Chain, spark: SparkSession, sf_dir: str, fuse: bool = True, shared: frozenset[str] = frozenset()) -> None:
        self.chain, self.spark, self.sf_dir, self.fuse, self.shared = chain, spark, sf_dir, fuse, shared
        self.kept: list[DataFrame] = []
        self.inputs: list[DataFrame] = []
        self.frames: dict[str, Frame | Paired] = {}
        self.fused: dict[tuple, DataFrame] = {}

    def family(self, node: Aggregate) -> tuple | None:
        """Aggregates with equal families share one aggregation."""
        if not self.fuse or not node.measures or not node.dims or not (node.grouped or (node.rolling and self.chain.unique(node))):
            return None
        if any(isinstance(c, Call) and c.name.startswith("quantile") for c in node.calls):
            return None
        return (node.input.lower(), node.dims, node.condition, node.rolling, node.partition)

    def data(self, name: str) -> DataFrame:
        return self.frame(self.chain[name]).rows()

    def frame(self, node: Node) -> Frame | Paired:
        key = node.name.lower()
        if key not in self.frames:
            frame = self.make(node)
            if isinstance(frame, Paired) and key in self.shared:
                frame = self.plain(frame.rows(), node)
            self.frames[key] = frame
            if key in self.shared and all(frame.df is not k for k in self.kept):
                self.kept.append(frame.df.persist(StorageLevel.MEMORY_AND_DISK))
        return self.frames[key]

    def release(self) -> None:
        for df in self.kept:
            df.unpersist()

    def plain(self, df: DataFrame, node: Node) -> Frame:
        return Frame(df, tuple(self.chain.dims(node)), tuple(F.col(m) for m in self.chain.measures(node)))

    def make(self, node: Node) -> Frame | Paired:
        dims = tuple(self.chain.dims(node))
        plain = lambda df: self.plain(df, node)
        match node:
            case Source():
                df = node.load(self.spark, self.sf_dir)
                self.inputs.append(df)
                dealt(self.spark, self.inputs)
                return plain(df.select(*node.columns))
            case Aggregate():
                return self.paired(node, dims) or self.aggregated(node, dims) or plain(self.aggregation(node, list(dims), list(node.calls), self.chain.measures(node)))
            case Transform():
                return self.mapped(node, dims) or plain(transform.run(self.data(node.input), node, list(dims), self.chain.measures(node)))
            case Combine():
                return self.aligned(node, dims) or self.attached(node) or plain(
                    joining.run(self.data(node.left), self.data(node.right), node, self.chain.dims(self.chain[node.left]), self.chain.right_dims(node), self.chain.single(self.chain[node.right]))
                )
        raise TypeError(node)

    def aggregation(self, node: Aggregate, dims: list[str], calls: list, names: list[str], item: str | None = None) -> DataFrame:
        """``item``: the dimension by which rows go to tasks, so that what is then computed or joined by it needs no other exchange."""
        df = aggregate.filtered(self.data(node.input), node)
        if item is not None and not node.rolling:
            df, calls = aggregate.dealt(df, dims, calls, item)
        if node.rolling:
            return aggregate.rolled(df, dims, node.partition, calls, names)
        if not node.grouped:
            return df.select(*dims, *[column(c.args[0], F.col).alias(n) for c, n in zip(calls, names, strict=True)])
        return aggregate.grouped(df, dims, calls, names)

    def aggregated(self, node: Aggregate, dims: tuple[str, ...]) -> Frame | None:
        family = self.family(node)
        if family is None or not dims:
            return None
        calls = list(dict.fromkeys(c for n in self.chain.nodes if isinstance(n, Aggregate) and self.family(n) == family for c in n.calls))
        if family not in self.fused:
            item = next((p[2] for n in self.chain.nodes if isinstance(n, Aggregate) and (p := self.pairing(n)) and self.family(p[0]) == family), None)
            self.fused[family] = self.aggregation(node, list(dims), calls, [f"__f{k}" for k in range(len(calls))], item)
        return Frame(self.fused[family], dims, tuple(F.col(f"__f{calls.index(c)}") for c in node.calls), family)

    def mapped(self, node: Transform, dims: tuple[str, ...]) -> Frame | None:
        """Arithmetic over a fused node's rows."""
        base = self.frame(self.chain[node.input])
        if base.family is None or node.where or node.extract or node.order or node.limit is not None or dims != base.dims or (node.dims is not None and node.dims != dims):
            return None
        if node.measures is None:
            return base
        scope = {f"m{k}": m for k, m in enumerate(base.measures)}
        found = [expression(m)[0] for m in node.measures]
        if any(isinstance(e, Call) and e.name in RANKS for e in found):
            return None
        return replace(base, measures=tuple(column(e, lambda n: scope.get(n, F.col(n))) for e in found))

    def aligned(self, node: Combine, dims: tuple[str, ...]) -> Frame | None:
        """A join of two nodes of one family on all their dimensions."""
        a, b = self.frame(self.chain[node.left]), self.frame(self.chain[node.right])
        if a.family is None or a.family != b.family or sorted(node.on) != sorted((d, "=", d) for d in a.dims) or dims != a.dims:
            return None
        pick = lambda frame, m: frame.measures[int(m[1:])] if m else F.lit(None)
        return replace(a, measures=tuple(combine(pick(a, x), op, pick(b, y)) for x, op, y in node.measures), present=True)

    def paired(self, node: Aggregate, dims: tuple[str, ...]) -> Paired | None:
        found = self.pairing(node)
        if found is None:
            return None
        left, by, item, measure = found
        base = self.frame(left)
        cells = base.df.select(*self.chain.dims(left), base.measures[measure].alias("__cell"))
        return Paired(cells, by, item, "__cell", dims, pieces(self.spark, self.inputs), (lambda known: known["sum"],))

    def pairing(self, node: Aggregate) -> tuple[Aggregate, tuple[str, ...], str, int] | None:
        """Of a sum of products by pair of items, over a join of a fused aggregation with itself on all its other dimensions: the aggregation, those
        dimensions, the item's, and the measure's number."""
        dims, both, call = self.chain.dims(node), self.chain[node.input], node.calls[0] if len(node.calls) == 1 else None
        if not self.fuse or not isinstance(both, Combine) or node.condition or node.partition or not isinstance(call, Call) or call.name != "sum" or not isinstance(call.args[0], Name):
            return None
        left, right, name = self.chain[both.left], self.chain[both.right], call.args[0].name
        if not isinstance(left, Aggregate) or not isinstance(right, Aggregate) or self.family(left) is None or self.family(left) != self.family(right) or not left.grouped:
            return None
        by, own = [a for a, _, _ in both.on], self.chain.dims(left)
        items = [d for d in own if d not in by]
        if not by or any(op != "=" or a != b for a, op, b in both.on) or len(items) != 1 or {*dims} != {items[0], *(new for _, new in self.chain.right_dims(both))} or len(dims) != 2:
            return None
        a, op, b = both.measures[int(name[1:])] if name in self.chain.measures(both) else ("", "", "")
        if op != "*" or not a or not b or left.calls[int(a[1:])] != right.calls[int(b[1:])]:
            return None
        return left, tuple(by), items[0], int(a[1:])

    def attached(self, node: Combine) -> Paired | None:
        """A join of sums by pair with a node of one row an item: the measures that it brings are known before the pairs are made."""
        base, right = self.frame(self.chain[node.left]), self.chain[node.right]
        if not isinstance(base, Paired) or len(node.on) != 1 or node.on[0][1] != "=" or self.chain.dims(right) != [node.on[0][2]] or not self.chain.unique(right):
            return None
        item, _, dim = node.on[0]
        side, name = base.dims.index(item), right.name.lower()
        pick = lambda known, m, of: (of(known, m) if m else F.lit(None))
        left = lambda known, m: base.measures[int(m[1:])](known)
        brought = lambda known, m: known[f"{'ab'[side]}.{name}.{m}"]
        measures = tuple(lambda known, x=x, op=op, y=y: combine(pick(known, x, left), op, pick(known, y, brought)) for x, op, y in node.measures)
        seen = next((j[2] for j in base.joins if j[1] == name), None)
        join = (side, name, seen if seen is not None else self.data(right.name), dim, tuple(self.chain.measures(right)))
        return replace(base, measures=measures, joins=(*base.joins, join))


def read_often(chain: Chain, target: Node) -> frozenset[str]:
    """Aggregates and joins that several nodes of a target read."""
    inputs = [i.lower() for n in chain.needed(target) for i in n.inputs]
    return frozenset(i for i in inputs if inputs.count(i) > 1 and isinstance(chain[i], (Aggregate, Combine)))


def compile_node(chain: Chain, spark: SparkSession, sf_dir: str, name: str | None = None, fuse: bool = True) -> DataFrame:
    """The lazy DataFrame of a node (the first end, if none is named)."""
    return Compiler(chain, spark, sf_dir, fuse).frame(chain.target(name)).rows()
