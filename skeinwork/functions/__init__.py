"""What the functions of chain definitions mean, as Spark columns and as SQL text of three dialects. Built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinwork.parse import Binary, Call, Expr, Interval, Name, Number, Predicate, Star, Text

DIALECTS = ("spark", "duckdb", "clickhouse")
QUANTILES = {"quantile": None, "quantile2": 0.5, "quantile3": 0.75, "quantile_cont": None, "quantile_weibull": None}
MICROS = {"hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000}


def ieee_divide(a: Column, b: Column) -> Column:
    """Division of doubles that never fails: x / 0 is an infinity or NaN."""
    a, b = a.cast("double"), b.cast("double")
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    by_zero = F.when(a.isNull(), F.lit(None)).when((a == 0) | F.isnan(a), nan).when(a > 0, inf).otherwise(-inf)
    return F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


def combine(a: Column, op: str, b: Column) -> Column:
    match op:
        case "+":
            return a + b
        case "-":
            return a - b
        case "*":
            return a * b
        case "/":
            return ieee_divide(a, b)
        case "rsub":
            return b - a
        case "rdiv":
            return ieee_divide(b, a)
        case "left":
            return a
        case "right":
            return b
    raise ValueError(f"unknown combiner {op!r}")


def combine_sql(a: str, op: str, b: str, dialect: str) -> str:
    if op in ("/", "rdiv"):
        a, b = (a, b) if op == "/" else (b, a)
        if dialect != "spark":
            return f"{a} / {b}"
        a, b = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
        return (
            f"CASE WHEN {b} = 0 THEN CASE WHEN {a} IS NULL THEN NULL WHEN {a} = 0 OR isnan({a}) THEN double('NaN') WHEN {a} > 0 THEN double('Infinity') "
            f"ELSE double('-Infinity') END ELSE {a} / CASE WHEN {b} <> 0 THEN {b} END END"
        )
    return {"left": a, "right": b, "rsub": f"{b} - {a}"}.get(op, f"{a} {op} {b}")


def quantile_share(call: Call) -> float:
    fixed = QUANTILES[call.name]
    return fixed if fixed is not None else float(call.args[1].text) if len(call.args) > 1 else 0.25


def rounded(c: Column, digits: int) -> Column:
    """A double rounded as DuckDB rounds it: its product with a power of ten, halves away from zero, divided again. Spark's ``round`` goes by the decimal
    text instead, and where the product's own error reaches a half, about one value in 10 ** (16 - digits) over it, the two differ."""
    scale = 10.0**digits
    y = c * F.lit(scale)
    near = F.rint(y)
    whole = F.when(F.abs(y - near) == 0.5, y + F.signum(y) * 0.5).otherwise(near)
    return F.when(F.abs(y) < float("inf"), whole / F.lit(scale)).otherwise(c)


Scope = Callable[[str], Column]
Names = Callable[[str], str]


def column(e: Expr, scope: Scope) -> Column:
    """A scalar expression over an input's columns."""
    match e:
        case Number(text):
            return F.lit(float(text) if "." in text or "e" in text.lower() else int(text))
        case Text(value):
            return F.lit(value)
        case Name(name):
            return F.lit(None) if name == "null" else scope(name)
        case Binary(op, left, Interval(amount, unit)):
            return shifted(column(left, scope), amount if op == "+" else -amount, unit)
        case Binary(op, left, right):
            return combine(column(left, scope), op, column(right, scope))
        case Call(name, args, _):
            return scalar(name, args, scope)
    raise ValueError(f"no column for {e}")


def shifted(c: Column, amount: int, unit: str) -> Column:
    """Calendar shift of a date (months clamp to the month's end), or of a time of day in microseconds (no wrap at midnight)."""
    if unit in MICROS:
        return c + F.lit(amount * MICROS[unit])
    return F.date_add(c, amount) if unit == "day" else F.add_months(c, amount * (12 if unit == "year" else 1))


def scalar(name: str, args: tuple, scope: Scope) -> Column:
    if name == "date_add":
        return shifted(column(args[0], scope), args[1].amount, args[1].unit)
    if name == "date_trunc":
        return F.trunc(column(args[1], scope), {"month": "MM", "year": "YYYY"}[args[0].value.lower()])
    c = [column(a, scope) for a in args]
    match name:
        case "pow":
            return F.pow(c[0].cast("double"), c[1].cast("double"))
        case "ln":
            return F.ln(c[0])
        case "log" | "log10":
            return F.log10(c[0])
        case "round":
            return F.round(c[0], int(args[1].text) if len(args) > 1 else 0)
        case "year" | "month":
            return getattr(F, name)(c[0]).cast("long")
        case "datediff":
            return F.datediff(c[0], c[1]).cast("long")
        case "binning":
            if len(args) < 4:
                raise ValueError("binning needs a value and at least label, bound, label")
            out = None
            for label, bound in zip(c[1:-1:2], c[2:-1:2], strict=True):
                out = F.when(c[0] < bound, label) if out is None else out.when(c[0] < bound, label)
            return out.otherwise(c[-1])
    raise ValueError(f"unknown function {name!r}")


def sql(e: Expr, names: Names, dialect: str) -> str:
    """The same expression as text."""
    match e:
        case Number(text):
            return text
        case Text(value):
            return "'" + value.replace("'", "''") + "'"
        case Name(name):
            return "NULL" if name == "null" else names(name)
        case Star():
            return "*"
        case Binary(op, left, Interval(amount, unit)):
            return shifted_sql(sql(left, names, dialect), amount if op == "+" else -amount, unit, dialect)
        case Binary(op, left, right):
            a, b = (f"({sql(x, names, dialect)})" if isinstance(x, Binary) else sql(x, names, dialect) for x in (left, right))
            return combine_sql(a, op, b, dialect)
        case Call(name, args, _):
            return scalar_sql(name, args, names, dialect)
    raise ValueError(f"no text for {e}")


def shifted_sql(c: str, amount: int, unit: str, dialect: str) -> str:
    if unit in MICROS:
        return f"{c} + {amount * MICROS[unit]}" if amount >= 0 else f"{c} - {-amount * MICROS[unit]}"
    if dialect == "clickhouse":
        return f"add{unit.title()}s({c}, {amount})"
    if dialect == "spark":
        return f"date_add({c}, {amount})" if unit == "day" else f"add_months({c}, {amount * (12 if unit == 'year' else 1)})"
    return f"CAST({c} + INTERVAL ({amount}) {unit.upper()} AS DATE)"


def scalar_sql(name: str, args: tuple, names: Names, dialect: str) -> str:
    if name == "date_add":
        return shifted_sql(sql(args[0], names, dialect), args[1].amount, args[1].unit, dialect)
    s = [sql(a, names, dialect) for a in args]
    match name:
        case "date_trunc":
            return f"CAST(date_trunc({s[0]}, {s[1]}) AS DATE)"
        case "log" | "log10":
            return f"log10({s[0]})"
        case "year" | "month":
            return f"CAST(extract({name.upper()} FROM {s[0]}) AS BIGINT)"
        case "datediff":
            return f"CAST(date_diff('day', {s[1]}, {s[0]}) AS BIGINT)" if dialect != "spark" else f"CAST(datediff({s[0]}, {s[1]}) AS BIGINT)"
        case "binning":
            steps = " ".join(f"WHEN {s[0]} < {b} THEN {v}" for v, b in zip(s[1:-1:2], s[2:-1:2], strict=True))
            return f"CASE {steps} ELSE {s[-1]} END"
        case "pow" | "ln" | "round":
            return f"{name}({', '.join(s)})"
    raise ValueError(f"unknown function {name!r}")


def test(p: Predicate, scope: Scope) -> Column:
    c = scope(p.attr)
    if p.null:
        return c.isNull() if p.op == "=" else c.isNotNull()
    v = [column(x, scope) for x in p.values]
    match p.op:
        case "=":
            return c == v[0]
        case "!=":
            return c != v[0]
        case "<":
            return c < v[0]
        case "<=":
            return c <= v[0]
        case ">":
            return c > v[0]
        case ">=":
            return c >= v[0]
        case "between":
            return c.between(v[0], v[1])
        case "in":
            return c.isin(*v)
    raise ValueError(f"unknown comparison {p.op!r}")


def test_sql(p: Predicate, names: Names, dialect: str) -> str:
    c, v = names(p.attr), [sql(x, names, dialect) for x in p.values]
    if p.null:
        return f"{c} IS {'NOT ' * (p.op == '!=')}NULL"
    match p.op:
        case "between":
            return f"{c} BETWEEN {v[0]} AND {v[1]}"
        case "in":
            return f"{c} IN ({', '.join(v)})"
    return f"{c} {'<>' if p.op == '!=' else p.op} {v[0]}"
