"""The six chains: every step against DuckDB, and the ways of running them against each other."""

import json

import pytest
from engine_support import SMALL, alike

from skeinwork import cli
from skeinwork.execute import pipe, running, shown, stepwise
from skeinwork.plans import sqlgen
from skeinwork.plans.compiler import compile_node
from skeinwork.queries import every
from skeinwork.sources import definitions
from skeinwork.sources.catalog import CHAINS, TPC_C1, chain
from skeinwork.sources.tables import registered


@pytest.mark.parametrize("name", CHAINS)
def test_every_step_against_duckdb(spark, duck, name):
    found = CHAINS[name]
    for node in found.nodes:
        if node.inputs:
            want = duck.execute(f"SELECT {', '.join(found.columns(node))} FROM ({sqlgen.cte(found, node.name)}) AS r").fetchall()
            assert alike(compile_node(found, spark, SMALL, node.name).collect(), want), node.name


@pytest.mark.parametrize("name", CHAINS)
def test_ways_of_running_agree(spark, duck, name):
    found = CHAINS[name]
    registered(spark, SMALL, ("lineitem", "orders", "events"))
    want = pipe(found, spark, SMALL).collect()
    assert want
    assert alike(pipe(found, spark, SMALL, fuse=False).collect(), want)
    with running(found, spark, SMALL) as df:
        assert alike(df.collect(), want)
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    with stepwise(found, spark, SMALL) as (last, steps):
        assert alike(last.collect(), want)
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    assert [s.node for s in steps] == [n.name for n in found.nodes if n.inputs] and all(s.seconds >= 0 for s in steps)
    for write in (sqlgen.cte, sqlgen.nested):
        assert alike(duck.execute(write(found)).fetchall(), want)
    spark_sql = sqlgen.cte(found, dialect="spark").replace("SELECT * REPLACE (CAST(l_shipdate AS DATE) AS l_shipdate) FROM lineitem", "SELECT * EXCEPT (l_shipdate), CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem")
    assert alike(spark.sql(spark_sql).collect(), want)


def test_fusion_saves_a_scan_and_a_join(spark):
    plan = lambda fuse: compile_node(TPC_C1, spark, SMALL, "Q3", fuse)._jdf.queryExecution().executedPlan().toString()
    assert plan(True).count("FileScan") == 1 and "Join" not in plan(True)
    assert plan(False).count("FileScan") == 2 and "Join" in plan(False)


def test_scans_read_only_what_they_need(spark):
    plan = compile_node(TPC_C1, spark, SMALL, "Q3")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_discount:double>" in plan


HAND = {
    "agg_sum": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS m0 FROM lineitem GROUP BY ALL",
    "slice_eq": "SELECT l_suppkey, sum(l_quantity) AS m0 FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey",
    "filter_between": "SELECT l_suppkey, l_partkey, sum(l_quantity) FROM lineitem WHERE l_partkey BETWEEN 10 AND 40 GROUP BY ALL",
    "join_theta_lt": "SELECT DISTINCT a.l_orderkey, a.l_partkey, b.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey",
    "rank_part_desc": "SELECT l_suppkey, l_partkey, rank() OVER (PARTITION BY l_partkey ORDER BY sum(l_quantity) DESC) FROM lineitem GROUP BY l_suppkey, l_partkey",
    "quantile_disc_75": "SELECT l_suppkey, quantile_disc(l_extendedprice, 0.75) FROM lineitem GROUP BY l_suppkey",
    "join_scalar_cross": "SELECT l_partkey, sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem) FROM lineitem GROUP BY l_partkey",
    "roll_sum": """SELECT d, c, t, sum(p) OVER (ORDER BY d, c, t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) FROM
                   (SELECT CAST(ts AS DATE) d, event_type c, hour(ts) t, sum(value) p FROM events GROUP BY ALL)""",
    "trunc_month": "SELECT CAST(date_trunc('month', l_shipdate) AS DATE), l_returnflag, sum(l_quantity) FROM lineitem GROUP BY ALL",
}


@pytest.mark.parametrize("name", HAND)
def test_operators_against_sql_by_hand(spark, duck, name):
    """The generator must not be its own only witness."""
    assert alike(every()[name].run(spark, SMALL).collect(), duck.execute(HAND[name]).fetchall())


def test_sql_forms():
    steps = sqlgen.steps(TPC_C1)
    assert steps["Q1"] == "SELECT l_suppkey, l_partkey, max(l_discount) AS m0 FROM lineitem GROUP BY l_suppkey, l_partkey ORDER BY l_suppkey, l_partkey"
    assert "ORDER BY" not in sqlgen.steps(TPC_C1, sort=False)["Q1"]
    assert "quantileExactLow(0.75)(m0)" in sqlgen.steps(chain("s-c1"), "clickhouse")["Q6"]
    assert sqlgen.cte(TPC_C1).startswith("WITH lineitem__ AS (") and sqlgen.nested(TPC_C1, "Q3").count("SELECT") >= 4


def test_command_line(spark):
    session = lambda: spark
    assert "TPC-C1\t14 steps" in cli.run("list", session)
    assert cli.run("list tpc-c1.Q3", session).startswith("SELECT a.l_suppkey")
    assert "Q14:" in cli.run("list TPC-C1 --deep --nosort", session) and "WITH" in cli.run("show TPC-C1 --cte", session)
    answer = cli.run("exec TPC-C1.Q6 --size=0.001 --limit=2", session).splitlines()
    assert answer[0].startswith("Q1\t") and "l_suppkey\tm0" in answer and answer[-1].endswith(" ms")
    assert "l_suppkey\tm0" in cli.run("query TPC-C1 --pipe --size=0.001", session)
    assert cli.run("quit", session) is None and "exec" in cli.run("help", session)
    assert shown(spark.sql("SELECT DATE'2024-01-02' AS d, 1.5D AS x")).splitlines()[-1] == "2024-01-02\t1.5"
    with pytest.raises(KeyError):
        cli.run("list nothing", session)


@pytest.mark.parametrize("name", CHAINS)
def test_json_round_trip(name):
    again = definitions.chain_of(json.loads(definitions.dumps(CHAINS[name])))
    assert again.nodes == CHAINS[name].nodes and again.title == CHAINS[name].title


def test_chains_of_a_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,x\n1,2.5\n1,0.5\n2,7\n")
    (tmp_path / "own.json").write_text(json.dumps({"name": "own", "nodes": [
        {"source": "t", "columns": ["k", "x"], "path": str(tmp_path / "t.csv"), "schema": "k long, x double"},
        {"aggregate": "A", "input": "t", "dims": ["k"], "measures": ["sum(x)"]}, {"transform": "B", "input": "A", "where": "m0 > 4"},
    ]}))
    answer = cli.run(f"exec own.b --file={tmp_path}/own.json --pipe", lambda: spark)
    assert answer.splitlines()[2] == "2\t7.0"
    assert "own\t2 steps" in cli.run(f"list --file={tmp_path}/own.json", lambda: spark)
    with pytest.raises(ValueError, match="unknown fields"):
        definitions.node_of({"aggregate": "A", "input": "t", "colour": 1})
    with pytest.raises(ValueError, match="a node is"):
        definitions.node_of({"other": "A"})


def test_entry_file(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 90
