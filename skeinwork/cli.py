"""Command line: list chains, print their SQL, run them.

list | show                         the chains
list CHAIN [--deep|--cte]           SQL of each step (nested or as one statement with --deep / --cte)
list CHAIN.Q                        nested SQL that ends at Q
exec | query CHAIN[.Q]              run; options: --pipe --size=0.01 --limit=10
options of both: --nosort --dialect=duckdb|spark|clickhouse (--clickhouse), --size=, --root=FOLDER, --file=CHAINS.json
help | ?   exit | quit
"""

from __future__ import annotations

import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from skeinwork.execute import pipe, shown, sorted_result, stepwise
from skeinwork.plans import sqlgen
from skeinwork.model import Chain
from skeinwork.sources import definitions
from skeinwork.sources.catalog import CHAINS, find, folder


def options(words: list[str]) -> tuple[list[str], dict[str, str]]:
    plain = [w for w in words if not w.startswith("--")]
    found = dict((w[2:].split("=", 1) + ["yes"])[:2] for w in words if w.startswith("--"))
    if "clickhouse" in found:
        found["dialect"] = "clickhouse"
    return plain, found


def known(given: dict[str, str]) -> dict[str, Chain]:
    """The built-in chains, and those of a file."""
    return CHAINS | (definitions.load(given["file"]) if "file" in given else {})


def listing(words: list[str]) -> str:
    plain, given = options(words)
    if not plain:
        return "\n".join(f"{c.name}\t{sum(1 for n in c.nodes if n.inputs)} steps\t{c.title}" for c in known(given).values())
    name, _, node = plain[0].partition(".")
    found, dialect, sort = find(known(given), name), given.get("dialect", "duckdb"), "nosort" not in given
    if node:
        return sqlgen.nested(found, node, dialect, sort)
    if "cte" in given:
        return "\n\n".join(f"{n.name}:\n{sqlgen.cte(found, n.name, dialect, sort)}" for n in found.ends())
    if "deep" in given:
        return "\n\n".join(f"{n.name}:\n{sqlgen.nested(found, n.name, dialect, sort)}" for n in found.nodes if n.inputs)
    return "\n".join(f"{k}:\t{v}" for k, v in sqlgen.steps(found, dialect, sort).items() if found[k].inputs)


def execution(words: list[str], session: Callable[[], SparkSession]) -> str:
    plain, given = options(words)
    name, _, node = plain[0].partition(".")
    found, node = find(known(given), name), node or None
    sf_dir = folder(given.get("size", "0.01"), given.get("root", os.environ.get("BENCH_ROOT", "/root/testdata")))
    began, lines, limit = time.time(), [], int(given.get("limit", 10))
    ordered = lambda df: df if "nosort" in given else sorted_result(df, found, node)
    if "pipe" in given:
        lines.append(shown(ordered(pipe(found, session(), sf_dir, node)), limit))
    else:
        with stepwise(found, session(), sf_dir, node) as (df, steps):
            lines = [f"{s.node}\t{s.rows} rows\t{1000 * s.seconds:.0f} ms" for s in steps]
            lines.append(shown(ordered(df), limit))
    return "\n".join([*lines, f"{1000 * (time.time() - began):.0f} ms"])


def run(line: str, session: Callable[[], SparkSession]) -> str | None:
    """The answer to a line; None ends the session."""
    words = line.split()
    match words[0].lower() if words else "":
        case "list" | "show":
            return listing(words[1:])
        case "exec" | "query" if len(words) > 1:
            return execution(words[1:], session)
        case "exit" | "quit":
            return None
        case "":
            return ""
    return __doc__.strip()


def main(argv: list[str]) -> int:
    session = lambda: SparkSession.builder.appName("skeinwork").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    lines = [" ".join(argv)] if argv else sys.stdin
    for line in lines:
        try:
            answer = run(line, session)
        except (KeyError, ValueError) as e:
            answer = f"error: {e}"
        if answer is None:
            break
        print(answer, flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
