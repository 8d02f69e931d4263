import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>, score string, rank string, v string"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", "x", "x") for i, v in vectors], SCHEMA)


def brute(vectors, asks, k=10):
    good = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in sorted({i: v for i, v in sorted(good, reverse=True) if asks(i)}.items()):
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return out


@pytest.mark.parametrize("kind", ["normal", "clustered", "coarse", "skewed", "huge"])
def test_against_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 150)
    monkeypatch.setattr(T, "QUERY_BLOCK", 7)
    r = np.random.default_rng(2)
    x = r.normal(size=(500, 12))
    if kind == "clustered":
        x = x * 0.05 + r.normal(size=(5, 12))[r.integers(0, 5, 500)]
    if kind == "coarse":  # many ties
        x = np.round(x)
    if kind == "skewed":
        x *= r.exponential(size=(500, 1)) * 10
    if kind == "huge":
        x *= 1e5
    vectors = list(enumerate(x.astype(np.float32).tolist()))
    got = T.top_k(table(spark, vectors), F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == brute(vectors, lambda i: i % 20 == 0)


def test_edges(spark):
    vectors = [
        (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.5, 0.5]), (5, [0.5, 0.5]), (6, []), (7, [-0.0001, 3.0]),
        (8, [1.0, 2.0, 3.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (60, [9.0]), (None, [1.0, 1.0]),
    ]
    got = T.top_k(table(spark, vectors), F.col("vec_id") % 20 == 0, k=3).collect()
    assert sorted(map(tuple, got)) == brute(vectors, lambda i: i % 20 == 0, 3)
    assert T.top_k(table(spark, []), F.col("vec_id") % 20 == 0).collect() == []
