"""One query per operator, and the six chains: each a small chain, compiled for Spark and written as SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import rounded
from skeinwork.model import Aggregate, Chain, Combine, Node, Transform
from skeinwork.plans.compiler import compile_node
from skeinwork.plans.sqlgen import cte
from skeinwork.sources.catalog import CHAINS, on, op
from skeinwork.sources.tables import LINEITEM, NATION, PART, REGION, RETAIL, STOCK, TICKS

#: Decimals to which both engines' doubles are rounded: their sums differ in the last digits.
DIGITS = 6


@dataclass(frozen=True)
class Query:
    chain: Chain
    whole: frozenset[str] = frozenset()  # measures that are not doubles
    node: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = compile_node(self.chain, spark, sf_dir, self.node)
        return df.select(*[rounded(F.col(c), DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

    def sql(self) -> str:
        node = self.chain.target(self.node)
        measures = [m if m in self.whole else f"round({m}, {DIGITS}) AS {m}" for m in self.chain.measures(node)]
        return f"SELECT {', '.join([*self.chain.dims(node), *measures])} FROM ({cte(self.chain, self.node)}) AS result"


SUPPLIER_PART = ("l_suppkey", "l_partkey")
FLAGS = ("l_returnflag", "l_linestatus")
CELL = ("Date", "Code", "Time")
PRICES = Aggregate("P", "part", ("p_partkey", "p_brand"), ("max(p_retailprice)",))
BY_PART = Aggregate("A", "lineitem", ("l_partkey",), ("sum(l_quantity)", "max(l_discount)"))
BY_SUPPLIER = Aggregate("S", "lineitem", ("l_suppkey",), ("sum(l_quantity)",))
BY_PAIR = Aggregate("B", "lineitem", SUPPLIER_PART, ("sum(l_quantity)",))
DAILY = Aggregate("D", "lineitem", ("l_shipdate", "l_returnflag"), ("sum(l_quantity)",))
CELLS = Aggregate("C", "Stock", CELL, ("sum(Price)", "max(High)", "min(Low)"))
TOTAL = Aggregate("T", "lineitem", (), ("sum(l_quantity)",))


def query(*nodes: Node, whole: str = "", name: str = "q") -> Query:
    return Query(Chain(name, list(nodes)), frozenset(whole.split()))


def aggregates() -> dict[str, Query]:
    one = lambda measure, whole="", dims=FLAGS, where="": query(LINEITEM, Aggregate("R", "lineitem", dims, (measure,), where), whole=whole)
    out = {
        "agg_sum": one("sum(l_quantity)"),
        "agg_avg": one("avg(l_quantity)"),
        "agg_max": one("max(l_discount)", dims=SUPPLIER_PART),
        "agg_min": one("min(l_discount)", dims=SUPPLIER_PART),
        "agg_count": one("count(*)", "m0", SUPPLIER_PART),
        "agg_count_column": one("count(l_shipdate)", "m0"),
        "agg_count_distinct": one("count(distinct l_partkey)", "m0", ("l_suppkey",)),
        "agg_global": query(LINEITEM, Aggregate("R", "lineitem", (), ("sum(l_quantity)", "count(*)")), whole="m1"),
        "agg_multi": query(LINEITEM, Aggregate("R", "lineitem", ("l_suppkey",), ("sum(l_quantity)", "avg(l_discount)", "max(l_tax)", "count(*)")), whole="m3"),
        "agg_filtered": one("avg(l_discount)", dims=("l_suppkey",), where="l_returnflag != 'R' and l_quantity > 10"),
        "agg_expr_sum": query(RETAIL, Aggregate("R", "retail", ("CustomerID", "StockCode"), ("sum(Quantity * Price)",), "CustomerID is not null")),
        "agg_raw": one("raw(l_extendedprice)", dims=("l_orderkey", "l_linenumber")),
        "agg_date_max": one("max(l_shipdate)", "m0"),
        "distinct_dims": query(RETAIL, Aggregate("R", "retail", ("Invoice", "StockCode"))),
        "nested_fn_agg": one("sum(pow(l_discount, 2))", dims=("l_suppkey",)),
    }
    for kind in ("disc", "cont", "weibull"):
        for share in ("25", "50", "75"):
            function = "quantile" if kind == "disc" else f"quantile_{kind}"
            out[f"quantile_{kind}_{share}"] = one(f"{function}(l_extendedprice, 0.{share})", dims=("l_suppkey",))
    for kind in ("quantile", "quantile_cont", "quantile_weibull"):
        out[f"{kind}_global"] = one(f"{kind}(l_extendedprice, 0.25)", dims=())
    for n, plain in (("", "25"), ("2", "50"), ("3", "75")):
        out[f"quantile_named_{plain}"] = one(f"quantile{n}(l_quantity)", dims=("l_partkey",))
    return out


def transforms() -> dict[str, Query]:
    part = lambda name="R", **k: query(LINEITEM, BY_PART, Transform(name, "A", **k))
    pair = lambda **k: query(LINEITEM, BY_PAIR, Transform("R", "B", **k))
    day = lambda **k: query(LINEITEM, DAILY, Transform("R", "D", **k))
    raw = Aggregate("W", "lineitem", ("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate"), ("raw(l_extendedprice)", "raw(l_discount)"))
    return {
        "project_bag": pair(dims=("l_suppkey",)),
        "alias_dim": query(LINEITEM, BY_PART, Transform("X", "A", ("l_partkey as item",)), Aggregate("R", "X", ("item",), ("sum(m0)",))),
        "filter_cmp_measure": part(where="m0 >= 500 and m0 != 600 and m1 < 1"),
        "filter_cmp_dim_int": pair(where="l_suppkey <= 3 and l_partkey > 1000"),
        "filter_cmp_dim_str": day(where="l_returnflag > 'A'"),
        "filter_cmp_dim_date": day(where="l_shipdate >= '1997-03-01' and l_shipdate < '1998-01-01'"),
        "filter_in": pair(where="l_suppkey in (1, 5, 9)"),
        "filter_between": pair(where="l_partkey between 10 and 40"),
        "filter_null": query(RETAIL, Aggregate("A", "retail", ("CustomerID",), ("count(*)",)), Transform("R", "A", where="CustomerID is not null"), whole="m0"),
        "slice_eq": query(LINEITEM, Aggregate("R", "lineitem", ("l_suppkey", "l_returnflag"), ("sum(l_quantity)",), "l_returnflag = 'R'")),
        "slice_eq_two": query(STOCK, CELLS, Transform("R", "C", where="Date = '2024-01-10' and Code = 'click'")),
        "slice_is_null": query(RETAIL, Aggregate("R", "retail", ("CustomerID", "StockCode"), ("count(*)",), "CustomerID is null"), whole="m0"),
        "filter_then_pow": part(measures=("pow(m0, 2)",), where="m0 > 700"),
        "rank_part_asc": query(LINEITEM, BY_PAIR, Transform("R", "B", measures=("rank(m0)",), partition=("l_partkey",)), whole="m0"),
        "rank_part_desc": query(LINEITEM, BY_PAIR, Transform("R", "B", measures=("rank_desc(m0)",), partition=("l_partkey",)), whole="m0"),
        "row_number_part": query(LINEITEM, BY_PAIR, Transform("R", "B", measures=("row_number(m0, l_suppkey)",), partition=("l_partkey",)), whole="m0"),
        "rank_global": query(LINEITEM, BY_PART, Transform("R", "A", measures=("rank(m0)",)), whole="m0"),
        "ntile": query(LINEITEM, BY_PART, Transform("R", "A", measures=("ntile(m0, 10, l_partkey)",)), whole="m0"),
        "order_limit": part(order=("m0 desc", "l_partkey"), limit=25),
        "topk_rank": query(LINEITEM, BY_PAIR, Transform("K", "B", measures=("rank_desc(m0)",), partition=("l_partkey",)), Transform("R", "K", where="m0 < 3"), whole="m0"),
        "arith_const": part(measures=("m0 * 100", "1 - m1")),
        "pow": part(measures=("pow(m0, 0.5)",)),
        "ln": part(measures=("ln(m0)",)),
        "log10": part(measures=("log10(m0)", "log(m0)")),
        "round": part(measures=("round(m0 / 7, 1)", "round(m0)")),
        "binning": query(LINEITEM, BY_PART, Transform("R", "A", measures=("binning(m0, 1, 300, 2, 600, 3, 900, 4)",)), whole="m0"),
        "date_add_day": day(dims=("date_add(l_shipdate, 10 day)", "l_returnflag")),
        "date_add_month": day(dims=("date_add(l_shipdate, -1 month)", "l_returnflag")),
        "date_add_year": day(dims=("date_add(l_shipdate, 1 year)", "l_returnflag")),
        "time_add_minute": query(TICKS, Aggregate("A", "ticks", ("event_id", "Time"), ("sum(Price)",)), Transform("R", "A", ("event_id", "Time + 1 minute as Time"))),
        "time_add_hour": query(TICKS, Aggregate("A", "ticks", ("event_id", "Time"), ("sum(Price)",)), Transform("R", "A", ("event_id", "Time + 1 hour as Time"))),
        "time_add_second": query(TICKS, Aggregate("A", "ticks", ("event_id", "Time"), ("sum(Price)",)), Transform("R", "A", ("event_id", "Time + 30 second as Time"))),
        "row_number_global": query(LINEITEM, BY_PAIR, Transform("R", "B", measures=("row_number(m0, l_suppkey, l_partkey)",)), whole="m0"),
        "rank_global_date": query(LINEITEM, Aggregate("A", "lineitem", ("l_shipdate",), ("sum(l_quantity)",)), Transform("R", "A", measures=("rank_desc(l_shipdate)",)), whole="m0"),
        "trunc_month": query(LINEITEM, DAILY, Transform("X", "D", ("date_trunc('month', l_shipdate)", "l_returnflag")), Aggregate("R", "X", ("l_shipdate", "l_returnflag"), ("sum(m0)",))),
        "trunc_year": query(LINEITEM, DAILY, Transform("X", "D", ("date_trunc('year', l_shipdate)", "l_returnflag")), Aggregate("R", "X", ("l_shipdate", "l_returnflag"), ("sum(m0)",))),
        "extract_year_month": day(extract=("year(l_shipdate) as y", "month(l_shipdate) as mon")),
        "date_diff": day(extract=("datediff(l_shipdate, date_trunc('year', l_shipdate)) as since",)),
        "raw_then_filter": query(LINEITEM, raw, Transform("R", "W", where="l_returnflag = 'R' and m1 > 0.05")),
    }


def joins() -> dict[str, Query]:
    pairs = [Aggregate("L", "lineitem", SUPPLIER_PART, ("sum(l_quantity)",)), Aggregate("G", "lineitem", SUPPLIER_PART, ("sum(l_tax)",), "l_quantity > 25")]
    two = lambda sign: query(LINEITEM, *pairs, Combine("R", "L", "G", on(*SUPPLIER_PART), op(sign)))
    flags = [Aggregate("F", "lineitem", ("l_returnflag",), ("sum(l_quantity)",)), Aggregate("G", "lineitem", ("l_linestatus",), ("sum(l_quantity)",))]
    out = {f"join_{name}": two(sign) for name, sign in {"add": "+", "sub": "-", "mul": "*", "div": "/", "rev_sub": "rsub", "rev_div": "rdiv", "left_only": "left", "right_only": "right"}.items()}
    out |= {
        "join_both_measures": query(LINEITEM, *pairs, Combine("R", "L", "G", on(*SUPPLIER_PART), (("m0", "left", ""), ("", "right", "m0")))),
        "join_div_by_zero": query(LINEITEM, BY_PART, Transform("Z", "A", measures=("m0 - m0", "m0 - 500")), Combine("R", "A", "Z", on("l_partkey"), (("m0", "/", "m0"),))),
        "join_dims_only": query(RETAIL, Aggregate("A", "retail", ("Invoice", "StockCode")), Aggregate("B", "retail", ("Invoice", "CustomerID")), Combine("R", "A", "B", on("Invoice"))),
        "join_renamed_key": query(LINEITEM, PART, BY_PAIR, PRICES, Combine("R", "B", "P", (("l_partkey", "=", "p_partkey"),), op("*"))),
        "join_theta_lt": query(RETAIL, Aggregate("A", "retail", ("Invoice", "StockCode")), Combine("R", "A", "A", (("Invoice", "=", "Invoice"), ("StockCode", "<", "StockCode")))),
        "join_theta_ne": query(RETAIL, Aggregate("A", "retail", ("Invoice", "StockCode")), Combine("R", "A", "A", (("Invoice", "=", "Invoice"), ("StockCode", "!=", "StockCode")))),
        "join_theta_ge": query(LINEITEM, Aggregate("A", "lineitem", ("l_suppkey", "l_returnflag"), ("sum(l_quantity)",)), Combine("R", "A", "A", (("l_suppkey", "=", "l_suppkey"), ("l_returnflag", ">=", "l_returnflag")), op("/"))),
        "join_theta_pure": query(NATION, REGION, Aggregate("A", "nation", ("n_nationkey",)), Aggregate("B", "region", ("r_regionkey",)), Combine("R", "A", "B", (("n_nationkey", ">", "r_regionkey"),))),
        "join_scalar_cross": query(LINEITEM, BY_PART, TOTAL, Combine("R", "A", "T", (), op("/"))),
        "join_cartesian": query(LINEITEM, *flags, Combine("R", "F", "G", (), op("-"))),
        "join_trunc_key": query(
            LINEITEM, DAILY, Transform("X", "D", ("date_trunc('month', l_shipdate)", "l_returnflag")), Aggregate("M", "X", ("l_shipdate", "l_returnflag"), ("sum(m0)",)),
            Combine("R", "M", "X", on("l_shipdate", "l_returnflag"), op("-")),
        ),
        "join_right_dim": query(LINEITEM, BY_SUPPLIER, BY_PAIR, Combine("R", "S", "B", on("l_suppkey"), op("/"))),
        "join_many_to_many": query(LINEITEM, Aggregate("A", "lineitem", ("l_returnflag", "l_linenumber"), ("sum(l_quantity)",)), Aggregate("B", "lineitem", ("l_returnflag", "l_linestatus"), ("sum(l_quantity)",)), Combine("R", "A", "B", on("l_returnflag"), op("*"))),
        "join_shift_month": query(
            LINEITEM, DAILY, Transform("X", "D", ("date_trunc('month', l_shipdate)", "l_returnflag")), Aggregate("M", "X", ("l_shipdate", "l_returnflag"), ("sum(m0)",)),
            Transform("N", "M", ("date_add(l_shipdate, 1 month)", "l_returnflag")), Combine("R", "M", "N", on("l_shipdate", "l_returnflag"), op("-")),
        ),
    }
    return out


def windows() -> dict[str, Query]:
    roll = lambda f, **k: query(STOCK, CELLS, Aggregate("R", "C", CELL, (f,), **k))
    return {
        "roll_sum": roll("rsum(m0, 3)"),
        "roll_avg": roll("ravg(m0, 2)"),
        "roll_max": roll("rmax(m1, 2)"),
        "roll_min": roll("rmin(m2, 2)"),
        "roll_part": roll("rsum(m0, 2)", partition=("Code",)),
        "roll_filtered": roll("rmax(m1, 4)", where="m1 > 100"),
        "roll_one_dim": query(LINEITEM, BY_PART, Aggregate("R", "A", ("l_partkey",), ("rsum(m0, 3)", "rmax(m1, 5)"))),
        "roll_number_first": query(LINEITEM, BY_PAIR, Aggregate("R", "B", ("l_suppkey", "l_partkey"), ("ravg(m0, 4)",))),
        "roll_nonleaf": query(STOCK, CELLS, Aggregate("R0", "C", ("Date", "Code"), ("sum(m0)",)), Aggregate("R", "R0", ("Date", "Code"), ("ravg(m0, 3)",))),
    }


def chains() -> dict[str, Query]:
    out = {f"chain_{name.lower().replace('-', '_')}": Query(c) for name, c in CHAINS.items()}
    return out


def every() -> dict[str, Query]:
    return chains() | aggregates() | transforms() | joins() | windows()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in every().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql() for name, q in every().items()}
