"""Query chains: named nodes over sources. Four kinds: source, aggregate, transform, combine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from skeinwork.parse import Binary, Call, Expr, Name, Predicate, expression, predicates

AGGREGATES = ("sum", "avg", "max", "min", "count", "raw", "quantile", "quantile2", "quantile3", "quantile_cont", "quantile_weibull")
ROLLING = {"rsum": "sum", "ravg": "avg", "rmax": "max", "rmin": "min"}
RANKS = ("rank", "rank_desc", "row_number", "row_number_desc", "ntile")


@dataclass(frozen=True)
class Source:
    """A table of a folder, or a view over several. ``sql`` is the same view as text; a plain table has none."""

    name: str
    columns: tuple[str, ...]
    load: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None

    @property
    def inputs(self) -> tuple[str, ...]:
        return ()


@dataclass(frozen=True)
class Aggregate:
    """Filter, then group by ``dims`` (less those that an equality fixes). Without measures: distinct rows. Rolling functions
    group nothing: their frame is the n rows before in the order of all dims, within ``partition`` if there is one."""

    name: str
    input: str
    dims: tuple[str, ...] = ()
    measures: tuple[str, ...] = ()
    where: str = ""
    partition: tuple[str, ...] = ()

    @property
    def inputs(self) -> tuple[str, ...]:
        return (self.input,)

    @property
    def condition(self) -> tuple[Predicate, ...]:
        return predicates(self.where)

    @property
    def calls(self) -> tuple[Expr, ...]:
        return tuple(expression(m)[0] for m in self.measures)

    @property
    def rolling(self) -> bool:
        return any(isinstance(c, Call) and c.name in ROLLING for c in self.calls)

    @property
    def grouped(self) -> bool:
        """RAW alone passes cells through as they are."""
        return not self.rolling and not (self.measures and all(isinstance(c, Call) and c.name == "raw" for c in self.calls))


@dataclass(frozen=True)
class Transform:
    """Filter, then compute. ``dims``: names or functions (None: all that the input has); ``extract``: further dimensions;
    ``measures``: new m0, m1, ... (None: the input's). Rows are neither merged nor lost but by the filter and the limit."""

    name: str
    input: str
    dims: tuple[str, ...] | None = None
    measures: tuple[str, ...] | None = None
    where: str = ""
    partition: tuple[str, ...] = ()
    extract: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    limit: int | None = None

    @property
    def inputs(self) -> tuple[str, ...]:
        return (self.input,)

    @property
    def condition(self) -> tuple[Predicate, ...]:
        return predicates(self.where)


#: Ways to combine a left and a right measure.
COMBINERS = ("+", "-", "*", "/", "rsub", "rdiv", "left", "right")


@dataclass(frozen=True)
class Combine:
    """Inner join. ``on``: (left dim, comparison, right dim); ``measures``: (left measure, combiner, right measure)."""

    name: str
    left: str
    right: str
    on: tuple[tuple[str, str, str], ...] = ()
    measures: tuple[tuple[str, str, str], ...] = ()

    @property
    def inputs(self) -> tuple[str, ...]:
        return (self.left, self.right)


Node = Source | Aggregate | Transform | Combine


def dim_name(text: str) -> str:
    """What a dimension of a transform is called: its alias, or the column that its function is of."""
    found, alias = expression(text)
    if alias:
        return alias
    while not isinstance(found, Name):
        if isinstance(found, Binary):
            found = found.left
        else:
            found = next(a for a in found.args if isinstance(a, (Name, Call, Binary)))
    return found.name


@dataclass
class Chain:
    """Nodes by name, in an order in which inputs come first. Names are told apart without case."""

    name: str
    nodes: list[Node]
    title: str = ""
    index: dict[str, Node] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for node in self.nodes:
            for wanted in node.inputs:
                if wanted.lower() not in self.index:
                    raise ValueError(f"{self.name}.{node.name}: no earlier node {wanted!r}")
            if node.name.lower() in self.index:
                raise ValueError(f"{self.name}: two nodes are called {node.name!r}")
            self.index[node.name.lower()] = node
            self.check(node)

    def __getitem__(self, name: str) -> Node:
        if name.lower() not in self.index:
            raise KeyError(f"{self.name} has no node {name!r}")
        return self.index[name.lower()]

    def check(self, node: Node) -> None:
        dims = self.dims(node)
        if isinstance(node, Aggregate):
            missing = set(node.dims) - set(self.columns(self[node.input]))
        elif isinstance(node, Combine):
            missing = {a for a, _, _ in node.on} - set(self.dims(self[node.left])) | {b for _, _, b in node.on} - set(self.dims(self[node.right]))
            if bad := [op for _, op, _ in node.measures if op not in COMBINERS]:
                raise ValueError(f"{self.name}.{node.name}: unknown combiner {bad[0]!r}")
        else:
            missing = set()
        if missing:
            raise ValueError(f"{self.name}.{node.name}: no dimension {sorted(missing)}")
        if len(set(dims)) < len(dims):
            raise ValueError(f"{self.name}.{node.name}: dimensions repeat: {dims}")

    def dims(self, node: Node) -> list[str]:
        """A node's dimensions, in order."""
        if isinstance(node, Source):
            return list(node.columns)
        if isinstance(node, Combine):
            left, right = self.dims(self[node.left]), self.right_dims(node)
            return left + [new for _, new in right]
        sliced = {p.attr for p in node.condition if p.slices}
        if isinstance(node, Aggregate):
            return [d for d in node.dims if d not in sliced]
        given = self.dims(self[node.input]) if node.dims is None else node.dims
        return [dim_name(d) for d in given if dim_name(d) not in sliced] + [dim_name(e) for e in node.extract]

    def right_dims(self, node: Combine) -> list[tuple[str, str]]:
        """The right side's dimensions that a join keeps, each with the name it gets."""
        left, fixed = self.dims(self[node.left]), {b for _, op, b in node.on if op == "="}
        return [(d, f"{d}2" if d in left else d) for d in self.dims(self[node.right]) if d not in fixed]

    def measures(self, node: Node) -> list[str]:
        if isinstance(node, Source):
            return []
        if isinstance(node, Transform) and node.measures is None:
            return self.measures(self[node.input])
        return [f"m{k}" for k in range(len(node.measures))]

    def columns(self, node: Node) -> list[str]:
        return self.dims(node) + self.measures(node)

    def ends(self) -> list[Node]:
        used = {i.lower() for n in self.nodes for i in n.inputs}
        return [n for n in self.nodes if n.name.lower() not in used]

    def target(self, name: str | None = None) -> Node:
        """The named node, or the first end."""
        return self[name] if name else self.ends()[0]

    def needed(self, target: Node) -> list[Node]:
        """The nodes that a target rests on, itself last."""
        wanted, out = {target.name.lower()}, []
        for node in reversed(self.nodes):
            if node.name.lower() in wanted:
                wanted |= {i.lower() for i in node.inputs}
                out.append(node)
        return out[::-1]

    def single(self, node: Node) -> bool:
        """Whether the node has exactly one row, by its definition: a global aggregate, or measures computed from one."""
        if isinstance(node, Aggregate):
            return node.grouped and not self.dims(node) and bool(node.measures)
        return isinstance(node, Transform) and not node.where and node.limit is None and not node.extract and self.single(self[node.input])

    def unique(self, node: Node) -> bool:
        """Whether dimensions name at most one row of the node, by its definition."""
        if isinstance(node, Aggregate):
            return node.grouped or (self.unique(self[node.input]) and set(self.dims(self[node.input])) <= set(node.dims))
        if isinstance(node, Transform):
            fixed = {p.attr for p in node.condition if p.slices}
            given = self.dims(self[node.input]) if node.dims is None else list(node.dims)
            return self.unique(self[node.input]) and set(self.dims(self[node.input])) <= set(given) | fixed
        return False
