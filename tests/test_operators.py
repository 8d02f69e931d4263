"""Operators on small hand-made tables: SQL meaning, with expected rows written by hand or by plain Python."""

import datetime as dt
import itertools
import math

import pytest
from engine_support import SMALL, rows
from pyspark.sql import functions as F

from skeinwork.functions import rounded
from skeinwork.model import Aggregate, Chain, Combine, Source, Transform
from skeinwork.plans import sqlgen
from skeinwork.plans.compiler import compile_node
from skeinwork.sources.catalog import CHAINS
from skeinwork.sources.tables import file


def given(spark, data, schema, name="t"):
    df = spark.createDataFrame(data, schema)
    return Source(name, tuple(df.columns), lambda *_: df)


def run(spark, *nodes, fuse=True):
    return rows(compile_node(Chain("c", list(nodes)), spark, "", fuse=fuse).collect())


TIES = [("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 1.0), ("b", 4, 2.0)]


@pytest.mark.parametrize(("call", "want"), [
    ("rank(m0)", [("a", 1, 2), ("a", 2, 2), ("a", 3, 1), ("b", 4, 1)]),
    ("rank_desc(m0)", [("a", 1, 1), ("a", 2, 1), ("a", 3, 3), ("b", 4, 1)]),
    ("row_number(m0, k)", [("a", 1, 2), ("a", 2, 3), ("a", 3, 1), ("b", 4, 1)]),
    ("row_number_desc(m0, k)", [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 4, 1)]),
])
def test_ranks(spark, call, want):
    t = given(spark, TIES, "p string, k long, x double")
    assert run(spark, t, Aggregate("A", "t", ("p", "k"), ("sum(x)",)), Transform("R", "A", measures=(call,), partition=("p",))) == want


def test_rank_without_partition_and_ntile(spark):
    t, a = given(spark, TIES, "p string, k long, x double"), Aggregate("A", "t", ("k",), ("sum(x)",))
    assert run(spark, t, a, Transform("R", "A", measures=("rank(m0)",))) == [(1, 3), (2, 3), (3, 1), (4, 2)]
    assert run(spark, t, a, Transform("R", "A", measures=("ntile(m0, 2, k)",))) == [(1, 2), (2, 2), (3, 1), (4, 1)]


@pytest.mark.parametrize("call", ["rank(m0)", "rank_desc(m0)", "row_number(m0, k)", "row_number_desc(m0, k)", "ntile(m0, 7, k)", "ntile(m0, 50, k)"])
def test_global_ranks_against_one_window(spark, duck, call):
    values = [None, float("nan"), math.inf, -math.inf, 0.0, -0.0, 1e300, -1e300, 5.0, 5.0, *(float(k % 9) for k in range(25))]
    for data in (list(enumerate(values)), [(1, 2.0)], [(1, None)], []):
        t = given(spark, data, "k long, x double")
        chain = Chain("c", [t, Aggregate("A", "t", ("k",), ("max(x)",)), Transform("R", "A", measures=(call,))])
        duck.execute("CREATE OR REPLACE TEMP TABLE t (k BIGINT, x DOUBLE)")
        for row in data:
            duck.execute("INSERT INTO t VALUES (?, ?)", row)
        assert rows(compile_node(chain, spark, "").collect()) == rows(duck.execute(sqlgen.cte(chain)).fetchall()), (call, len(data))


def weibull(values, p):
    v, n = sorted(values), len(values)
    at = min(max(p * (n + 1), 1), n)
    low = math.floor(at)
    return v[low - 1] + (at - low) * (v[min(low, n - 1)] - v[low - 1])


@pytest.mark.parametrize("p", [0.25, 0.5, 0.75])
def test_quantiles(spark, p):
    groups = {n: [float((7 * k) % 11) for k in range(n)] for n in range(1, 7)}
    t = given(spark, [(n, x) for n, v in groups.items() for x in v] + [(3, None)], "g int, x double")
    disc = [(n, sorted(v)[max(1, math.ceil(p * n)) - 1]) for n, v in groups.items()]
    assert run(spark, t, Aggregate("R", "t", ("g",), (f"quantile(x, {p})",))) == disc
    assert run(spark, t, Aggregate("R", "t", ("g",), (f"quantile_weibull(x, {p})",))) == [(n, round(weibull(v, p), 6)) for n, v in groups.items()]
    cont = run(spark, t, Aggregate("R", "t", ("g",), (f"quantile_cont(x, {p})",)))
    assert cont == rows(spark.createDataFrame([(n, x) for n, v in groups.items() for x in v], "g int, x double").groupBy("g").agg(F.percentile("x", p)).collect())


DATES = [dt.date(2024, 1, 31), dt.date(2024, 2, 29), dt.date(2023, 12, 31), dt.date(1969, 12, 31)]


@pytest.mark.parametrize(("call", "want"), [
    ("date_add(d, 1 month)", ["2024-02-29", "2024-03-29", "2024-01-31", "1970-01-31"]),
    ("date_add(d, 1 year)", ["2025-01-31", "2025-02-28", "2024-12-31", "1970-12-31"]),
    ("date_add(d, -1 day)", ["2024-01-30", "2024-02-28", "2023-12-30", "1969-12-30"]),
    ("date_trunc('month', d)", ["2024-01-01", "2024-02-01", "2023-12-01", "1969-12-01"]),
    ("date_trunc('year', d)", ["2024-01-01", "2024-01-01", "2023-01-01", "1969-01-01"]),
])
def test_calendar(spark, call, want):
    t = given(spark, [(d, 1.0) for d in DATES], "d date, x double")
    assert run(spark, t, Transform("R", "t", (call,))) == sorted((w,) for w in want)


def test_time_passes_midnight(spark):
    late = (23 * 3600 + 59 * 60 + 30) * 1_000_000
    t = given(spark, [(late, 1.0)], "t long, x double")
    assert run(spark, t, Transform("R", "t", ("t + 1 minute as t",))) == [(late + 60_000_000,)]


def test_division_by_zero(spark):
    t = given(spark, [(1, 1.0, 0.0), (2, -1.0, 0.0), (3, 0.0, 0.0), (4, None, 0.0), (5, 1.0, None), (6, 6.0, 3.0)], "k long, a double, b double")
    nodes = (t, Aggregate("A", "t", ("k",), ("max(a)",)), Aggregate("B", "t", ("k",), ("max(b)",)), Combine("R", "A", "B", (("k", "=", "k"),), (("m0", "/", "m0"),)))
    for fuse in (True, False):
        assert run(spark, *nodes, fuse=fuse) == [(1, math.inf), (2, -math.inf), (3, "nan"), (4, None), (5, None), (6, 2.0)]


def test_all_negative_maximum_and_empty(spark):
    t = given(spark, [(1, -5.0), (1, -3.0)], "k long, x double")
    assert run(spark, t, Aggregate("R", "t", ("k",), ("max(x)",))) == [(1, -3.0)]
    e = given(spark, [], "k long, x double")
    assert run(spark, e, Aggregate("R", "t", ("k",), ("max(x)",))) == []
    assert run(spark, e, Aggregate("R", "t", (), ("max(x)", "count(*)"))) == [(None, 0)]
    assert run(spark, e, Aggregate("A", "t", ("k",), ("sum(x)",)), Aggregate("S", "t", (), ("sum(x)",)), Combine("R", "A", "S", (), (("m0", "/", "m0"),))) == []


def test_null_keys_fused_or_not(spark):
    t = given(spark, [(None, 1.0), (1, 2.0), (1, 5.0), (None, 3.0)], "k long, x double")
    nodes = (t, Aggregate("A", "t", ("k",), ("max(x)",)), Aggregate("B", "t", ("k",), ("min(x)",)), Combine("R", "A", "B", (("k", "=", "k"),), (("m0", "-", "m0"),)))
    assert run(spark, *nodes) == run(spark, *nodes, fuse=False) == [(1, 3.0)]
    assert run(spark, *nodes[:2]) == [(1, 5.0), (None, 3.0)]
    assert run(spark, t, Aggregate("R", "t", ("k",), ("count(*)",), "k is null")) == [(2,)]
    assert run(spark, t, Aggregate("R", "t", ("k",), ("count(*)",), "k is not null")) == [(1, 2)]


@pytest.mark.parametrize("op", ["=", "!=", "<", "<=", ">", ">="])
def test_theta_joins(spark, op):
    left, right = ["b", "d", "z"], ["a", "c", "d", "e"]
    compare = {"=": str.__eq__, "!=": str.__ne__, "<": str.__lt__, "<=": str.__le__, ">": str.__gt__, ">=": str.__ge__}[op]
    a, b = given(spark, [(x,) for x in left], "k string", "a"), given(spark, [(x,) for x in right], "k string", "b")
    want = sorted((x, y) for x, y in itertools.product(left, right) if compare(x, y))
    assert run(spark, a, b, Combine("R", "a", "b", (("k", op, "k"),))) == ([(x,) for x, _ in want] if op == "=" else want)


def test_projection_keeps_duplicates_and_distinct_drops_them(spark):
    t = given(spark, [("a", "x", 1.0), ("a", "y", 1.0), ("b", "x", 2.0)], "a string, b string, v double")
    assert run(spark, t, Transform("R", "t", ("a",))) == [("a",), ("a",), ("b",)]
    assert run(spark, t, Aggregate("R", "t", ("a",))) == [("a",), ("b",)]


@pytest.mark.parametrize("partition", [(), ("g",)])
@pytest.mark.parametrize("width", [1, 2, 4])
def test_rolling_crosses_groups(spark, partition, width):
    cells = [(g, k, float(10 * i + k)) for i, g in enumerate("abcd") for k in range(3 if g != "c" else 1)]
    t = given(spark, cells, "g string, t int, x double")
    want = []
    for i, (g, k, _) in enumerate(cells):
        before = [c for c in cells[max(0, i - width) : i + 1] if not partition or c[0] == g]
        want.append((g, k, sum(c[2] for c in before), max(c[2] for c in before)))
    for nodes in ((t, Aggregate("R", "t", ("g", "t"), (f"rsum(x, {width})", f"rmax(x, {width})"), partition=partition)),):
        assert run(spark, *nodes) == rows(want)


def test_filter_sees_the_input(spark):
    t = given(spark, [(1, 3.0), (2, 1.0)], "k long, x double")
    assert run(spark, t, Aggregate("A", "t", ("k",), ("sum(x)",)), Transform("R", "A", measures=("pow(m0, 2)",), where="m0 > 2")) == [(1, 9.0)]


def test_order_limit_and_binning(spark):
    t = given(spark, [(k, float(k)) for k in range(6)], "k long, x double")
    a = Aggregate("A", "t", ("k",), ("sum(x)",))
    assert run(spark, t, a, Transform("R", "A", order=("m0 desc",), limit=2)) == [(4, 4.0), (5, 5.0)]
    assert run(spark, t, a, Transform("R", "A", measures=("binning(m0, 1, 2, 2, 4, 3)",))) == [(0, 1), (1, 1), (2, 2), (3, 2), (4, 3), (5, 3)]


def test_csv_source(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,x\n1,2.5\n1,0.5\n")
    t = file("t", str(tmp_path / "t.csv"), "k", "x", schema="k long, x double")
    assert run(spark, t, Aggregate("R", "t", ("k",), ("sum(x)",))) == [(1, 3.0)]


def test_chain_checks():
    t = Source("t", ("k",), None)
    with pytest.raises(ValueError, match="no earlier node"):
        Chain("c", [Aggregate("A", "t")])
    with pytest.raises(ValueError, match="no dimension"):
        Chain("c", [t, Aggregate("A", "t", ("z",))])
    with pytest.raises(ValueError, match="two nodes"):
        Chain("c", [t, Aggregate("T", "t", ("k",))])
    with pytest.raises(ValueError, match="unknown combiner"):
        Chain("c", [t, Aggregate("A", "t", ("k",), ("count(*)",)), Combine("R", "A", "A", (("k", "=", "k"),), (("m0", "%", "m0"),))])
    assert Chain("c", [t, Aggregate("A", "t", ("k",), ("count(*)",))])["a"].name == "A"


def test_rounding_is_duckdbs(spark, duck):
    import random

    draw = random.Random(7)
    values = [round(draw.uniform(1, 9e6), 6) + draw.choice((4.9999999e-7, 5e-7, 5.0000001e-7)) for _ in range(20_000)]
    values += [0.0, -0.0, -1e-9, 0.5e-6, -0.5e-6, 2.5e-6, 1e300, -1e305, math.inf, -math.inf, math.nan, None, 0.49999999999999994e-6]
    found = spark.createDataFrame(list(enumerate(values)), "k long, x double").select("k", rounded(F.col("x"), 6).alias("x")).collect()
    got = [str(r.x) for r in sorted(found)]
    want = [str(duck.execute("SELECT round(CAST(? AS DOUBLE), 6)", [v]).fetchall()[0][0]) for v in values[-13:]]
    assert got[-13:] == want
    listed = duck.execute("SELECT list_transform(?::DOUBLE[], lambda x: round(x, 6))", [values[:-13]]).fetchall()[0][0]
    assert got[:-13] == [str(v) for v in listed]


def test_partitions_grow_with_the_input(spark, monkeypatch):
    from engine_support import SMALL

    from skeinwork.operators import ranges
    from skeinwork.queries import every

    options = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {o: spark.conf.get(o, None) for o in options}
    try:
        chain = every()["distinct_dims"].chain
        for size in (8 << 10, 4 << 10):
            monkeypatch.setattr(ranges, "FILE_BYTES", size)
            df = compile_node(chain, spark, SMALL)
            tables = [spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("lineitem", "orders")]
            wanted = -(-sum(map(ranges.stored_bytes, tables)) // size)
            assert wanted > 4
            assert f", {wanted}), ENSURE_REQUIREMENTS" in df._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(ranges, "FILE_BYTES", 1 << 30)
        compile_node(chain, spark, SMALL)  # a smaller input takes nothing back
        assert int(spark.conf.get(options[0])) == wanted
        assert ranges.stored_bytes(spark.createDataFrame([(1,)], "k long")) == 0
    finally:
        for o, v in before.items():
            spark.conf.unset(o) if v is None else spark.conf.set(o, v)


@pytest.mark.parametrize("p", [0, 0.25, 0.5, 0.75, 1])
def test_interpolated_quantiles_over_all_rows(spark, duck, p):
    call = f"quantile_cont(x, {p})"
    for values in ([], [None], [3.5], [4.0, 1.0], [2.0, None, 7.0, 7.0, -1.5], [float(7 * k % 11) for k in range(24)], [1.0, 2.0, math.inf], [None, 5.0, None]):
        t = given(spark, list(enumerate(values)), "k long, x double")
        chain = Chain("c", [t, Aggregate("R", "t", (), (call, "count(*)"))])
        df = compile_node(chain, spark, "")
        assert " percentile(" not in df._jdf.queryExecution().optimizedPlan().toString()  # it takes all distinct values to one task
        duck.execute("CREATE OR REPLACE TEMP TABLE t (k BIGINT, x DOUBLE)")
        for row in enumerate(values):
            duck.execute("INSERT INTO t VALUES (?, ?)", row)
        assert rows(df.collect()) == rows(duck.execute(sqlgen.cte(chain)).fetchall()), values


def test_range_search_compiles(spark):
    from skeinwork.operators import ranges

    values = [None, math.nan, math.inf, -math.inf, *(float(k * k % 101) for k in range(60))]
    df = ranges.ranged(spark.createDataFrame([(v,) for v in values], "x double"), F.col("x"), "r")
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()  # functions of rows are interpreted one by one
    found = [r for r in df.collect() if r.x is not None and r.x == r.x]
    assert all((a.r <= b.r) if a.x <= b.x else (a.r >= b.r) for a in found for b in found)
    assert {r.r for r in df.collect() if r.x is None} == {2**ranges.STEPS} and len({r.r for r in found}) > 30


PURCHASES = [
    (1, 10, 2.0), (1, 11, 3.0), (1, 11, 1.0), (1, 12, 0.0), (2, 10, -1.0), (2, 11, 5.0), (2, None, 4.0), (3, 12, 0.0), (3, None, 1.0), (None, 10, 9.0), (None, 13, 9.0),
    (4, 13, None), (4, 10, 1.5), (5, 14, float("inf")), (5, 10, 1.0), (6, 15, 7.0),
]


@pytest.mark.parametrize("sides", [("i",), ("i2",), ("i", "i2"), ("i2", "i"), ()])
@pytest.mark.parametrize("dims", [("i", "i2"), ("i2", "i")])
@pytest.mark.parametrize("least", ["", "m0 > 1"])
def test_sums_by_pair_and_later_joins_by_an_item(spark, sides, dims, least):
    """Nulls in keys and values, zero and infinite norms, items that a later join drops on one side or on both."""
    cells = lambda name: Aggregate(name, "t", ("c", "i"), ("sum(v)",))
    nodes = [given(spark, PURCHASES, "c int, i int, v double"), cells("A"), cells("B"), Combine("P", "A", "B", (("c", "=", "c"),), (("m0", "*", "m0"),)), Aggregate("S", "P", dims, ("sum(m0)",))]
    nodes += [Transform("Q", "A", measures=("pow(m0, 2)",)), Aggregate("N", "Q", ("i",), ("sum(m0)", "count(*)")), Transform("L", "N", where=least)]
    for k, side in enumerate(sides):
        nodes.append(Combine(f"J{k}", nodes[-1].name if k else "S", "L", ((side, "=", "i"),), (("m0", "/", "m0"), ("m0", "rsub", "m1"))))
    found = Chain("c", nodes)
    last = nodes[-1].name if sides else "S"
    got, want = (rows(compile_node(found, spark, "", last, fuse).collect()) for fuse in (True, False))
    assert got == want and len(want) > 3


def test_pairs_of_cells_go_through_no_exchange(spark):
    """Pairs are made and summed, and joins by an item done, without moving a pair: nothing stands above the generation of pairs but rows' own arithmetic."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = compile_node(CHAINS["OR-C2"], spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    above = plan.split("Generate posexplode")[0]
    assert "HashAggregate" in above and "Exchange" not in above and "Join" not in above


@pytest.mark.parametrize("kind", ["int", "double", "string", "date"])
@pytest.mark.parametrize("sides", [("i", "i2"), ("i2",), ()])
def test_sums_by_pair_over_many_blocks(spark, monkeypatch, kind, sides):
    """Groups that touch several blocks, items with and without an order, nulls among them."""
    from skeinwork.operators import pairs

    monkeypatch.setattr(pairs, "TURNS", 3)
    made = {"int": lambda k: k, "double": lambda k: k / 4 - 3, "string": lambda k: f"s{k}", "date": lambda k: dt.date(2024, 1, 1 + k)}[kind]
    data = [(c, None if (c + k) % 17 == 0 else made(k), float(c * k % 7) - 2) for c in range(12) for k in range(25) if (c * 7 + k * k) % 3] + [(c, made(24), math.inf) for c in (1, 5)]
    cells = lambda name: Aggregate(name, "t", ("c", "i"), ("sum(v)",))
    nodes = [given(spark, data, f"c int, i {kind}, v double"), cells("A"), cells("B"), Combine("P", "A", "B", (("c", "=", "c"),), (("m0", "*", "m0"),)), Aggregate("S", "P", ("i", "i2"), ("sum(m0)",))]
    nodes.append(Aggregate("N", "A", ("i",), ("count(*)",)))
    for k, side in enumerate(sides):
        nodes.append(Combine(f"J{k}", nodes[-1].name if k else "S", "N", ((side, "=", "i"),), (("m0", "/", "m0"),)))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "15")  # five blocks
    try:
        found = compile_node(Chain("c", nodes), spark, "", f"J{len(sides) - 1}" if sides else "S")
        assert "direct_shuffle_partition_id(block" in found._jdf.queryExecution().executedPlan().toString() and "), 5), REPARTITION" in found._jdf.queryExecution().executedPlan().toString()
        got, want = rows(found.collect()), rows(compile_node(Chain("c", nodes), spark, "", f"J{len(sides) - 1}" if sides else "S", False).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert got == want and len(want) > 400


def test_a_group_goes_once_to_each_block(spark):
    """What is moved before pairs are made: not a row for each cell with all that follow it."""
    from skeinwork.operators import pairs

    data = [(c, 100 * (c % 4) + k, 1.0) for c in range(20) for k in range(30)]
    cells = pairs.blocked(spark.createDataFrame(data, "c int, i int, v double"), "i", "v", 4)
    moved = pairs.tails(cells, ["c"], ["i", "v"], 4).collect()
    assert sum(r.own for r in moved) == 600 and all(len(r.all0) >= r.own for r in moved)
    assert len(moved) <= 2 * 20 and sum(len(r.all0) for r in moved) <= 2 * 600  # 600 rows with 9,300 cells, if each cell went with those from itself on
    assert {r.block for r in moved} == {0, 1, 2, 3}
    for blocks in (1, 4):  # each turn has tasks of its own
        sums = pairs.summed(pairs.blocked(cells.drop("__block"), "i", "v", blocks), ["c"], "i", "v", [], blocks, 3)
        assert sums.rdd.getNumPartitions() >= 3 * blocks and sums.count() == 4 * 900


def test_cells_go_through_one_exchange_by_item(spark):
    """Cells, the search for cuts, norms and the join with them share it, and all turns share the exchange of groups."""
    kept = {o: spark.conf.get(o) for o in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = compile_node(CHAINS["OR-C2"], spark, SMALL)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        for o, v in kept.items():
            spark.conf.set(o, v)
    made = [x.split("Exchange ")[1].split("(")[0] for x in plan.splitlines() if "Exchange " in x and "Reused" not in x and "Broadcast" not in x]
    # orders, lines, cells by item, cells by customer, groups by block; SinglePartition for the cuts
    assert sorted(made)[1:] == ["hashpartitioning"] * 4 + ["shufflepartitionidpassthrough"], made
