"""Time the six chains over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

A chain's time is that of one plan whose last step is counted and summed, with the rows that several steps read kept meanwhile and
released at the end: the median of three runs after one that warms up.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.execute import running
from skeinwork.sources.catalog import CHAINS


def consume(df: DataFrame) -> None:
    measures = [c for c, t in df.dtypes if c.startswith("m")]
    df.agg(F.count(F.lit(1)), *[f(F.col(c)) for c in measures for f in (F.sum, F.min, F.max)]).collect()


def main() -> int:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name, chain in CHAINS.items():
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            with running(chain, spark, sf_dir) as df:
                consume(df)
            runs.append(time.perf_counter() - began)
        took[name] = round(median(runs[1:]), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "six query chains, warm, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
