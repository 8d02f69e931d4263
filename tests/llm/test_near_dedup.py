import random
import re

import numpy as np
import pytest

from skeinwork.llm import near_dedup as N
from skeinwork.llm import shingles as S
from skeinwork.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(texts, width):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOW))
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()})
    return out


def brute(ids, sets, percent=80):
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(ids[a]), find(ids[b])))
                label[y] = x
    return {i: find(i) for i in ids}


def edited(text, share, seed):
    r, words = random.Random(seed), text.split(" ")
    for _ in range(max(1, int(share * len(words)))):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def corpus(prose, edges):
    base = [prose(n, n) for n in (30, 60, 120, 200, 400)]
    texts = [*edges, *base, *base[1:3], base[0].upper()]
    texts += [edited(t, share, seed) for t in base for share in (0.01, 0.03, 0.05, 0.08) for seed in range(4)]
    texts += [f"{base[3]} {prose(60, 90 + k)}" for k in range(6)]  # a long passage that several share
    return texts


@pytest.mark.parametrize("width", [4, 5])
def test_against_brute_force(make, prose, edges, width):
    texts = corpus(prose, edges)
    ids = list(range(100, 100 + len(texts)))
    random.Random(1).shuffle(ids)
    sets = sets_of(texts, width)
    want = brute(ids, sets)
    got = N.groups(make(list(zip(ids, texts, strict=True))), width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), want[i], want[i] == i) for i, s in zip(ids, sets, strict=True)}
    assert 1 < len({c for c in want.values()}) < len(ids)


def test_a_group_of_near_copies_that_no_single_document_links(make, prose, monkeypatch):
    """Blocks of small parts, as for a bucket of thousands."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 8)
    base = prose(150, 77)
    texts = [edited(base, 0.03, k) for k in range(70)]
    want = brute(list(range(70)), sets_of(texts, 5))
    assert {r.doc_id: r.component_id for r in N.groups(make(texts)).collect()} == want


def test_stage_keeps_one_of_each_group(make, prose):
    docs = make([(5, "a b c d e f"), (3, "A b c d e f"), (9, None), (8, ""), (7, "x y"), (2, "x y"), (None, "x y"), (None, None)])
    kept = N.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 2), (False, 3), (False, 8), (False, 9), (True, 0), (True, 0)]


def test_repeated_rows_and_empty_table(make):
    got = N.groups(make([(4, "a b c d e"), (4, "a b c d e"), (1, "a b c d e")])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (4, 1, False), (4, 1, False)]
    assert N.groups(make([])).collect() == [] and N.kept_documents(make([])).collect() == []


def test_an_id_with_several_texts(make, prose):
    """It counts with one of its texts, the same one whatever the order of the rows; each row keeps the size of its own set."""
    one, two = prose(60, 3), prose(80, 4)
    items = [(4, one), (4, two), (4, ""), (7, one), (8, two), (9, prose(50, 9))]
    for order in (items, items[::-1]):
        got = N.groups(make(order).repartition(3)).collect()
        component = {r.doc_id: r.component_id for r in got}
        assert all(r.component_id in ((4, component[4]) if r.doc_id == 4 else (component[r.doc_id],)) for r in got)
        assert component[9] == 9 and sorted((component[7], component[8])) in ([4, 7], [4, 8])
        assert sorted(r.n_shingles for r in got if r.doc_id == 4) == [0, 56, 76]
        first = first if order is not items else sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got)
    assert first == sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got)


def test_a_large_group_with_few_strays_costs_a_row_a_member(make, prose, spark, monkeypatch):
    """Rows of the open blocks: linear where almost all members are of one component."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    ids = range(400)
    buckets = spark.createDataFrame([(64, k) for k in ids], "key long, id long")
    labels = spark.createDataFrame([(k, 0 if k < 397 else k) for k in ids], "id long, component long")
    signature = bytes(2 * S.SYMBOLS)
    reps = spark.createDataFrame([(k, 50, signature) for k in ids], "id long, n long, signature binary")
    rows = N.open_blocks(buckets, reps, labels, 80).collect()
    assert {r.id for r in rows} == set(ids) and len(rows) <= 400 + 3 * 26


def test_a_null_id_is_linked_with_nothing(make, prose):
    text = prose(60, 3)
    got = N.groups(make([(None, text), (None, text), (7, text), (9, text), (None, None)])).collect()
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 3
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(7, 7, True), (9, 7, False)]


def test_keys_find_every_pair_within_the_radius():
    r = np.random.default_rng(5)
    a = r.integers(0, 65536, (500, S.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for k in range(500):
        b[k, r.choice(S.SYMBOLS, k % (S.RADIUS + 1), replace=False)] += 1
    shared = S.chunk_keys(a) == S.chunk_keys(b)
    assert shared.any(axis=1).all()
    assert (S.first_shared_key(a, b) == shared.argmax(axis=1)).all()
    assert (S.first_shared_key(a, r.integers(0, 65536, a.shape).astype(np.uint16)) == -1).all()


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)] + [(200, k) for k in range(201, 230)]
    label = {x: x for p in links for x in p}
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {x.id: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: c for x, c in label.items() if any(x in p and p[0] != p[1] for p in links)}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
