"""Chains as JSON: a catalog of one's own, without Python code.

{"name": ..., "title": ..., "nodes": [{"source": "lineitem"}, {"source": "t", "columns": [...], "path": "t.csv", "schema": "k long"},
{"aggregate": "Q1", "input": ..., "dims": [...], "measures": [...], "where": ..., "partition": [...]}, {"transform": ...}, {"combine": "Q3",
"left": ..., "right": ..., "on": [["a", "=", "b"]], "measures": [["m0", "-", "m0"]]}]}. Fields at their defaults may be left out.
"""

from __future__ import annotations

import json
from dataclasses import MISSING, fields

from skeinwork.model import Aggregate, Chain, Combine, Node, Source, Transform
from skeinwork.sources import tables

KINDS = {"aggregate": Aggregate, "transform": Transform, "combine": Combine}
LOGICAL = {s.name: s for s in (tables.LINEITEM, tables.RETAIL, tables.STOCK, tables.TICKS, tables.PART, tables.NATION, tables.REGION)}


def frozen(value):
    return tuple(map(frozen, value)) if isinstance(value, list) else value


def node_of(item: dict) -> Node:
    if "source" in item:
        name = item["source"]
        if "path" in item:
            return tables.file(name, item["path"], *item["columns"], schema=item.get("schema"))
        return tables.table(name, *item["columns"]) if "columns" in item else LOGICAL[name]
    kind = next((k for k in KINDS if k in item), None)
    if kind is None:
        raise ValueError(f"a node is a source or one of {', '.join(KINDS)}: {item}")
    given = {k: frozen(v) for k, v in item.items() if k != kind}
    if unknown := set(given) - {f.name for f in fields(KINDS[kind])}:
        raise ValueError(f"{item[kind]}: unknown fields {sorted(unknown)}")
    return KINDS[kind](name=item[kind], **given)


def chain_of(data: dict) -> Chain:
    return Chain(data["name"], [node_of(n) for n in data["nodes"]], data.get("title", ""))


def item_of(node: Node) -> dict:
    if isinstance(node, Source):
        return {"source": node.name} if LOGICAL.get(node.name) is node else {"source": node.name, "columns": list(node.columns)}
    kind = next(k for k, c in KINDS.items() if isinstance(node, c))
    plain = {f.name: getattr(node, f.name) for f in fields(node) if f.name != "name" and (f.default is MISSING or getattr(node, f.name) != f.default)}
    return {kind: node.name} | plain


def dumps(chain: Chain) -> str:
    return json.dumps({"name": chain.name, "title": chain.title, "nodes": [item_of(n) for n in chain.nodes]}, indent=1)


def load(path: str) -> dict[str, Chain]:
    """The chains of a file that holds one definition or a list of them."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    return {c.name: c for c in map(chain_of, found if isinstance(found, list) else [found])}
