"""Sources: Parquet tables of a folder, CSV or Parquet files by path, and the two logical tables made from others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.model import Source


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(name: str, *columns: str) -> Source:
    """A table of the folder, as it is."""
    return Source(name, columns, lambda spark, sf_dir: read(spark, sf_dir, name))


def file(name: str, path: str, *columns: str, schema: str | None = None) -> Source:
    """A file by path: Parquet by its suffix, else CSV with a header; with a schema no pass infers types."""

    def load(spark: SparkSession, _: str) -> DataFrame:
        if path.endswith(".parquet"):
            return spark.read.parquet(path)
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)

    kind = "read_parquet" if path.endswith(".parquet") else "read_csv"
    return Source(name, columns, load, f"SELECT * FROM {kind}('{path}')")


def registered(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> None:
    """Temporary views of tables, for generated SQL."""
    for name in names:
        read(spark, sf_dir, name).createOrReplaceTempView(name)


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


def _retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    return items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("l_orderkey").alias("Invoice"), F.col("l_partkey").alias("StockCode"), F.col("o_custkey").alias("CustomerID"),
        F.col("l_quantity").alias("Quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("Price"),
    )


def _stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return read(spark, sf_dir, "events").select(
        ts.cast("date").alias("Date"), F.col("event_type").alias("Code"), F.hour(ts).cast("long").alias("Time"), F.col("value").alias("Price"),
    ).select("Date", "Code", "Time", "Price", F.col("Price").alias("High"), F.col("Price").alias("Low"))


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    micros = (F.hour(ts).cast("long") * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))) * 1_000_000
    return read(spark, sf_dir, "events").select("event_id", micros.alias("Time"), F.col("value").alias("Price"))


LINEITEM = Source(
    "lineitem", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    _lineitem, "SELECT * REPLACE (CAST(l_shipdate AS DATE) AS l_shipdate) FROM lineitem",
)
RETAIL = Source(
    "retail", ("Invoice", "StockCode", "CustomerID", "Quantity", "Price"), _retail,
    "SELECT l_orderkey AS Invoice, l_partkey AS StockCode, o_custkey AS CustomerID, l_quantity AS Quantity, l_extendedprice / l_quantity AS Price "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
STOCK = Source(
    "Stock", ("Date", "Code", "Time", "Price", "High", "Low"), _stock,
    "SELECT CAST(ts AS DATE) AS Date, event_type AS Code, CAST(extract(HOUR FROM ts) AS BIGINT) AS Time, value AS Price, value AS High, value AS Low FROM events",
)
TICKS = Source(
    "ticks", ("event_id", "Time", "Price"), _ticks,
    "SELECT event_id, CAST((extract(HOUR FROM ts) * 3600 + extract(MINUTE FROM ts) * 60 + floor(extract(SECOND FROM ts))) * 1000000 AS BIGINT) AS Time, value AS Price FROM events",
)
PART = table("part", "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
NATION = table("nation", "n_nationkey", "n_name", "n_regionkey")
REGION = table("region", "r_regionkey", "r_name")
