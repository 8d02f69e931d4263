"""The built-in chains, and folders of tables by scale."""

from __future__ import annotations

from skeinwork.model import Aggregate, Chain, Combine, Transform
from skeinwork.sources.tables import LINEITEM, RETAIL, STOCK


def on(*dims: str) -> tuple[tuple[str, str, str], ...]:
    """Equality on dimensions of the same names."""
    return tuple((d, "=", d) for d in dims)


def op(sign: str) -> tuple[tuple[str, str, str], ...]:
    return (("m0", sign, "m0"),)


TPC_C1 = Chain("TPC-C1", [
    LINEITEM,
    Aggregate("Q1", "lineitem", ("l_suppkey", "l_partkey"), ("max(l_discount)",)),
    Aggregate("Q2", "lineitem", ("l_suppkey", "l_partkey"), ("min(l_discount)",)),
    Combine("Q3", "Q1", "Q2", on("l_suppkey", "l_partkey"), op("-")),
    Transform("Q4", "Q3", measures=("rank_desc(m0)",), partition=("l_partkey",)),
    Transform("Q5", "Q4", where="m0 < 3"),
    Aggregate("Q6", "Q5", ("l_suppkey",), ("count(*)",)),
    Aggregate("Q7", "lineitem", ("l_suppkey", "l_returnflag", "l_linestatus", "l_partkey"), ("sum(l_quantity)",)),
    Aggregate("Q8", "Q7", ("l_suppkey", "l_returnflag"), ("sum(m0)",)),
    Aggregate("Q9", "Q7", ("l_suppkey",), ("sum(m0)",)),
    Combine("Q10", "Q8", "Q9", on("l_suppkey"), op("/")),
    Transform("Q11", "Q10", where="l_returnflag = 'R'"),
    Aggregate("Q12", "Q10", ("l_suppkey",), ("avg(m0)",), where="l_returnflag != 'R'"),
    Combine("Q13", "Q11", "Q12", on("l_suppkey"), op("/")),
    Combine("Q14", "Q6", "Q13", on("l_suppkey"), op("*")),
], "Supplier performance: top discounted parts times the return ratio")

TPC_C2 = Chain("TPC-C2", [
    LINEITEM,
    Aggregate("Q1", "lineitem", ("l_shipdate", "l_partkey"), ("sum(l_quantity)",)),
    Transform("Q2", "Q1", ("date_trunc('month', l_shipdate)", "l_partkey")),
    Aggregate("Q3", "Q2", ("l_shipdate", "l_partkey"), ("sum(m0)",)),
    Aggregate("Q4", "Q3", ("l_shipdate",), ("sum(m0)",)),
    Combine("Q5", "Q3", "Q4", on("l_shipdate"), op("/")),
    Transform("Q6", "Q5", measures=("m0 * 100",)),
    Transform("Q7", "Q6", ("date_add(l_shipdate, 1 month)", "l_partkey")),
    Combine("Q8", "Q6", "Q7", on("l_shipdate", "l_partkey"), op("-")),
    Transform("Q9", "Q8", where="m0 > 0"),
], "Monthly shipment trend: growth of each part's share, month over month")

OR_C1 = Chain("OR-C1", [
    RETAIL,
    Aggregate("Q1", "retail", ("Invoice", "StockCode")),
    Aggregate("Q2", "retail", ("Invoice", "StockCode")),
    Combine("Q3", "Q1", "Q2", (("Invoice", "=", "Invoice"), ("StockCode", "<", "StockCode"))),
    Aggregate("Q4", "Q3", ("StockCode", "StockCode2"), ("count(*)",)),
    Aggregate("Q5", "Q3", (), ("count(distinct Invoice)",)),
    Combine("Q6", "Q4", "Q5", (), op("/")),
    Aggregate("Q7", "retail", ("StockCode",), ("count(distinct Invoice)",)),
    Aggregate("Q8", "retail", (), ("count(distinct Invoice)",)),
    Combine("Q9", "Q7", "Q8", (), op("/")),
    Combine("Q10", "Q6", "Q9", on("StockCode"), op("/")),
], "Market basket: lift of item pairs")

OR_C2 = Chain("OR-C2", [
    RETAIL,
    Aggregate("Q1", "retail", ("CustomerID", "StockCode"), ("sum(Quantity * Price)",), where="CustomerID is not null"),
    Aggregate("Q2", "retail", ("CustomerID", "StockCode"), ("sum(Quantity * Price)",), where="CustomerID is not null"),
    Combine("Q3", "Q1", "Q2", on("CustomerID"), op("*")),
    Aggregate("Q4", "Q3", ("StockCode", "StockCode2"), ("sum(m0)",)),
    Transform("Q5", "Q1", measures=("pow(m0, 2)",)),
    Aggregate("Q6", "Q5", ("StockCode",), ("sum(m0)",)),
    Transform("Q7", "Q6", measures=("pow(m0, 0.5)",)),
    Combine("Q8", "Q4", "Q7", on("StockCode"), op("/")),
    Combine("Q9", "Q8", "Q7", (("StockCode2", "=", "StockCode"),), op("/")),
], "Item-to-item cosine similarity")

CELL = ("Date", "Code", "Time")
S_C1 = Chain("S-C1", [
    STOCK,
    Aggregate("Q0", "Stock", CELL, ("max(High)", "min(Low)")),
    Aggregate("Q1", "Q0", CELL, ("rmax(m0, 2)",)),
    Aggregate("Q2", "Q0", CELL, ("rmin(m1, 2)",)),
    Combine("Q3", "Q1", "Q2", on(*CELL), op("-")),
    Combine("Q4", "Q3", "Q2", on(*CELL), op("/")),
    Transform("Q5", "Q4", measures=("m0 * 100",), where="m0 != 0"),
    Aggregate("Q6", "Q5", ("Date",), ("quantile(m0, 0.75)",)),
    Combine("Q7", "Q5", "Q6", on("Date"), op("-")),
    Transform("Q8", "Q7", where="m0 > 0"),
    Aggregate("Q9", "Q8", ("Date", "Code"), ("count(*)",)),
    Aggregate("Q10", "Q9", ("Date",), ("quantile(m0, 0.75)",)),
    Combine("Q11", "Q9", "Q10", on("Date"), op("-")),
    Transform("Q12", "Q11", where="m0 > 0"),
], "Volatility anomalies")

REFERENCE = "Date = '2024-01-10' and Code = 'click'"
S_C2 = Chain("S-C2", [
    STOCK,
    Aggregate("Q1", "Stock", CELL, ("sum(Price)",)),
    Transform("Q2", "Q1", ("Date", "Code", "Time + 1 as Time")),
    Combine("Q3", "Q1", "Q2", on(*CELL), op("-")),
    Aggregate("Q4", "Q3", ("Date", "Code"), ("avg(m0)",)),
    Combine("Q5", "Q3", "Q4", on("Date", "Code"), op("-")),
    Transform("Q6", "Q5", where=REFERENCE),
    Combine("Q7", "Q5", "Q6", on("Time"), op("*")),
    Aggregate("Q8", "Q7", ("Date", "Code"), ("avg(m0)",)),
    Transform("Q9", "Q5", measures=("pow(m0, 2)",)),
    Aggregate("Q10", "Q9", ("Date", "Code"), ("avg(m0)",)),
    Transform("Q11", "Q10", measures=("pow(m0, 0.5)",), where="m0 != 0"),
    Transform("Q12", "Q11", where=REFERENCE),
    Combine("Q13", "Q11", "Q12", (), op("*")),
    Combine("Q14", "Q8", "Q13", on("Date", "Code"), op("/")),
], "Correlation with a reference series")

CHAINS = {c.name: c for c in (TPC_C1, TPC_C2, OR_C1, OR_C2, S_C1, S_C2)}


def find(chains: dict[str, Chain], name: str) -> Chain:
    """A chain by name, without regard to case."""
    found = {k.lower(): c for k, c in chains.items()}.get(name.lower())
    if found is None:
        raise KeyError(f"no chain {name!r}; there are {', '.join(chains)}")
    return found


def chain(name: str) -> Chain:
    """A built-in chain."""
    return find(CHAINS, name)


def folder(size: str, root: str) -> str:
    """The folder of tables of a scale factor."""
    return f"{root}/sf{size}"
