import zlib

import numpy as np
import pytest

from skeinwork.llm import nb_svm as B
from skeinwork.llm.lexer import lex

LABELS = "doc_id long, quality int, toxic int, text string"


def training(make, spark, prose, n=240):
    texts, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        text = prose(60 + k % 50, k)
        texts.append("!! ".join(text.upper().split(" ")) if bad and k % 8 else text.replace(" ", " | ") if bad else text)
        labels.append((k, 0 if bad else 1, 0, "clash"))
    return make(texts), spark.createDataFrame(labels, LABELS), labels


def test_learns_and_scores_held_out_rows(make, spark, prose):
    docs, labels, truth = training(make, spark, prose)
    got = {r.doc_id: r for r in B.classify(docs, labels).collect()}
    held = [k for k, *_ in truth if zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(held) > 30 and all(got[k].held_out == (k in held) for k in got)
    assert np.mean([got[k].predicted == q for k, q, *_ in truth if k in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_held_out_labels_are_never_learned(make, spark, prose):
    docs, labels, truth = training(make, spark, prose, 80)
    flipped = spark.createDataFrame([(k, 1 - q if zlib.crc32(str(k).encode()) % 4 == 2 else q, 0, "") for k, q, *_ in truth], LABELS)
    one, two = ({r.doc_id: r.score for r in B.classify(docs, x).collect()} for x in (labels, flipped))
    assert one == two


def test_edges(make, spark, edges):
    docs = make([*edges, "a b", "a b"])
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in B.classify(docs, none).collect()} == {0.5}
    odd = spark.createDataFrame([(4, 1, 0, ""), (4, 1, 0, ""), (5, None, 0, ""), (None, 0, 0, ""), (999, 0, 0, "")], LABELS)
    got = {r.doc_id: r.score for r in B.classify(docs, odd).collect()}
    assert len(got) == len(edges) + 2 and got[len(edges)] == got[len(edges) + 1] and got[0] == got[1]
    assert B.classify(make([]), none).collect() == []


def test_dual_descent_reaches_the_optimum():
    r = np.random.default_rng(0)
    x = r.normal(size=(60, 5))
    y = np.where(x @ np.array([1, -2, 0.5, 0, 3]) + 0.3 * r.normal(size=60) > 0, 1, -1)
    feats, bounds = np.tile(np.arange(5), 60), np.arange(0, 301, 5)
    cost = np.full(60, 0.7)
    w = B.dual_descent(feats, x.ravel(), bounds, y, cost, 5, epochs=3000, least=1e-9)
    value = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w[:5] + w[5]))).sum()
    best = value(w)
    assert all(value(w + d) >= best - 1e-3 for d in r.normal(size=(300, 6)) * r.choice([0.001, 0.01, 0.1], (300, 1)))


def test_ratios():
    feats, rows, y = np.array([0, 1, 0, 2]), np.array([0, 0, 1, 1]), np.array([1, -1])
    got = B.log_count_ratios(feats, rows, y, 3)
    p, q = np.array([2, 2, 1]) / 5, np.array([2, 1, 2]) / 5
    assert np.allclose(got, np.log(p / q))


@pytest.mark.parametrize("text", ["a b a", "", "A!! b"])
def test_features_are_indicators(text):
    data = np.frombuffer(text.encode(), np.uint8)
    feats, bounds = B.features(lex(data, np.array([0, len(data)])))
    assert len(set(feats.tolist())) == len(feats) == bounds[-1] and (bounds[-1] == 0) == (text == "")


def test_names_of_labels_clash_with_the_operators_own(make, spark, prose):
    docs, labels, _ = training(make, spark, prose, 120)
    more = labels.selectExpr("*", "'x' AS label", "'x' AS features", "'x' AS held_out", "'x' AS row", "'x' AS score", "'x' AS n")
    want, got = ({r.doc_id: tuple(r) for r in B.classify(docs, x).collect()} for x in (labels, more))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
