import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skeinwork.llm import gru
from skeinwork.llm import lm_scoring as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(items):
    tokens = {k: [*WORD.findall((t or "").translate(LOW)), "\0end"] for k, t in items}
    counts = Counter(w for k, ws in tokens.items() if zlib.crc32(str(k).encode()) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    base = {k: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) for k, ws in tokens.items()}
    return {k: (zlib.crc32(str(k).encode()) % 10 == 0, len(ws), sum(counts[w] > 0 for w in ws), n, base[k]) for k, ws in tokens.items()}


@pytest.mark.parametrize("head", [1 << 18, 40, 0])
def test_counts_and_base(make, prose, edges, head):
    """Whatever the head holds, the rest is joined."""
    items = list(enumerate([*edges, *(prose(30 + 5 * k, k) for k in range(40)), "Unseen" + prose(9, 99)]))
    got = {r.doc_id: r for r in L.scores(make(items), head=head, shard=2000).collect()}
    want = brute(items)
    assert set(got) == set(want)
    for k, (held, n, known, total, base) in want.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_model_learns_order(make):
    """Words follow one another in a fixed order: a unigram model cannot know it."""
    ring = [f"w{k:02d}" for k in range(60)]
    items = [(k, " ".join(ring[(k + j) % 60] for j in range(150 + k % 20))) for k in range(300)]
    rows = [r for r in L.scores(make(items)).collect() if r.held_out]
    assert len(rows) > 15 and sum(r.score for r in rows) > 0.8 * sum(r.base_score for r in rows)


@pytest.mark.parametrize("shard", [1 << 21, 40])
def test_every_training_document_is_fitted(make, shard, monkeypatch):
    """The embedding of a word moves only where a document with it is read; here each document has words of its own."""
    monkeypatch.setattr(L, "EPOCHS", 0)
    docs = make([(k, f"alpha{k} beta{k} gamma{k}") for k in range(60)]).coalesce(1)
    words = L.vocabulary(L.stored(L.counted(docs), "counts"))
    params = L.fitted(L.stored(L.coded(docs, words), "coded"), words, shard)
    trained = np.setdiff1d(words.code[words.code >= 0], [words.end])
    moved = np.abs(params["E"] - gru.start(words.output, words.code_counts)["E"]).max(axis=1)
    assert len(trained) > 100 and (moved[trained] > 1e-5).all()


def test_the_layout_of_the_table_has_no_part_in_the_result(make, prose, edges):
    items = list(enumerate([*edges, *(prose(30 + 5 * k, k) for k in range(60))]))
    one, two = ({r.doc_id: (r.score, r.base_score) for r in L.scores(make(x), shard=1500).collect()} for x in (items, items[::-1]))
    three = {r.doc_id: (r.score, r.base_score) for r in L.scores(make(items).repartition(11), shard=1500).collect()}
    assert set(one) == set(two) == set(three)
    assert all(one[k] == pytest.approx(x[k], rel=1e-6) for k in one for x in (two, three))


def plain_score(text, p, words, counts):
    """One token after the other, gate by gate: class, word in its class, and the share of its form's rest."""
    logistic = lambda x: 1 / (1 + np.exp(-x))
    h, last, total = np.zeros(gru.STATE), words.end, 0.0
    data = text.encode()
    lexed = L.lex(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    names, form = lexed.hashes(lower=True), L.forms(lexed)
    coded = {int(k): int(c) for k, c in zip(words.keys, words.code, strict=True) if c >= 0}
    steps = [(coded.get(int(w), -1), int(f), counts.get(int(w), 0)) for w, f in zip(names, form, strict=True)] + [(words.end, 0, 0)]
    for code, form, n in steps:
        code, rest = (code, 0.0) if code >= 0 else (gru.WORDS + form, math.log10((n + 0.1) / words.rest[form]))
        a, u = p["E"][last] @ p["W"] + p["b"], h @ p["R"]
        S = gru.STATE
        z, r = logistic(a[:S] + u[:S]), logistic(a[S : 2 * S] + u[S : 2 * S])
        h = z * h + (1 - z) * np.tanh(a[2 * S :] + r * u[2 * S :])
        share = np.exp(h @ p["C"] + p["c"])
        cls = int(words.output.cls[code])
        total += math.log10(share[cls] / share.sum())
        if cls >= gru.SINGLES:
            members = words.output.members[cls - gru.SINGLES]
            share = np.exp(p["U"][members] @ h + p["u"][members])
            total += math.log10(share[list(members).index(code)] / share.sum())
        total, last = total + rest, code
    return total


@pytest.mark.parametrize("head", [1 << 18, 30])
def test_score_is_that_of_a_plain_loop(make, prose, edges, monkeypatch, head):
    texts = ["", "a", "Unseen words " + prose(40, 5), *(prose(150, k, words=3000) for k in range(60))]
    docs = make(texts)
    seen = {}
    keep = lambda name: lambda *a, **k: seen.setdefault(name, real[name](*a, **k))
    real = {"vocabulary": L.vocabulary, "fitted": L.fitted}
    for name in real:
        monkeypatch.setattr(L, name, keep(name))
    got = {r.doc_id: r.score for r in L.scores(docs, head=head).collect()}
    counts = {r.word % 2**64: r.n for r in L.counted(docs).collect()}
    assert len(counts) > gru.WORDS
    p = {k: v.astype(np.float64) for k, v in seen["fitted"].items()}
    for k, text in enumerate(texts):
        assert got[k] == pytest.approx(plain_score(text, p, seen["vocabulary"], counts), rel=1e-4), k


def test_no_training_and_empty(make):
    assert L.scores(make([])).collect() == []
    rows = L.scores(make([(None, "a b"), (None, None)])).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens) for r in rows) == [(1, 0, 0), (3, 0, 0)] and all(math.isfinite(r.score) for r in rows)


def small():
    r = np.random.default_rng(0)
    out = gru.Output.of(r.integers(0, gru.FORMS, gru.WORDS))
    return r, out, gru.start(out, r.integers(1, 100, gru.CODES).astype(float))


def test_probabilities_sum_to_one():
    r, out, p = small()
    states = r.normal(size=(gru.STATE, 3)).astype(np.float32)
    for s in states.T:
        logs = gru.log_probabilities(p, out, np.repeat(np.append(s, np.float32(1))[:, None], gru.CODES, axis=1), np.arange(gru.CODES))
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_softmax_beyond_the_range_of_exponentials(kind):
    """Columns whose exponentials are infinite, or all 0, are computed less their largest; the others are as they were."""
    r = np.random.default_rng(5)
    weights, states, at = r.normal(size=(7, 4)).astype(kind), r.normal(size=(4, 9)).astype(kind), r.integers(0, 7, 9)
    weights[:, 3], states[3] = 1, 0
    states[3, 2], states[3, 5] = 2000, -2000  # adds to all logits of a column alike
    states[:3, 7] *= 2000
    logits = weights.astype(float) @ states
    top = logits.max(axis=0)
    want = logits - top - np.log(np.exp(logits - top).sum(axis=0))
    logs, e, total = gru.settled(weights, states, at)
    assert np.isfinite(logs).all() and logs == pytest.approx(want[at, np.arange(9)], rel=1e-3, abs=1e-3)
    assert e / total == pytest.approx(np.exp(want), abs=1e-3)
    loss, d_weights, d_states = gru.descent(weights, states, at, weights)
    d = np.exp(want)
    d[at, np.arange(9)] -= 1
    assert loss == pytest.approx(-want[at, np.arange(9)].sum(), rel=1e-3)
    near = 1e-5 if kind is np.float64 else 1e-3
    assert d_states == pytest.approx((weights.T @ d).T, abs=10 * near) and d_weights == pytest.approx(d @ states.T, abs=near * float(np.abs(states).max()))


def test_gradients():
    r, out, p = small()
    docs = [r.integers(0, gru.CODES, n).astype(np.int32) for n in (5, 9, 3, 12)]
    read, target, doc = gru.stream(docs, [[0, 2], [1], [3]], [0] * 4)
    new = np.ones_like(doc, bool)
    new[1:] = doc[1:] != doc[:-1]
    p = {k: v.astype(np.float64) for k, v in p.items()}
    h = np.zeros((gru.STATE, 3))
    g, _, loss = gru.window_gradients(p, out, read, target, doc, new, h)
    for k in p:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        ends = []
        for e in (1e-4, -1e-4):
            q = {a: b.copy() for a, b in p.items()}
            q[k][at] += e
            ends.append(gru.window_gradients(q, out, read, target, doc, new, h)[2])
        assert g[k][at] == pytest.approx((ends[0] - ends[1]) / 2e-4, rel=1e-3, abs=1e-5)


def test_state_is_carried_across_windows_and_lanes_do_not_matter():
    r, out, p = small()
    docs = [r.integers(0, gru.CODES, n).astype(np.int32) for n in (300, 70, 1, 64, 65, 500, 2)]
    whole = gru.score(p, out, docs, 0, window=1000)
    assert np.allclose(whole, gru.score(p, out, docs, 0, window=64), rtol=1e-4)
    assert np.allclose(whole, [gru.score(p, out, [d], 0, window=7)[0] for d in docs], rtol=1e-4)
    assert len(gru.score(p, out, [], 0)) == 0


def test_parts_of_a_long_document_are_all_read():
    """Training reads a long document in parts; each knows the word before it."""
    r, out, p = small()
    doc = r.integers(0, gru.CODES, 3 * gru.PART + 5).astype(np.int32)
    trainer = gru.Trainer(p, out, 0)
    assert trainer.fit([doc], 0.01, 8) > 0
    moved = np.abs(trainer.params["E"] - p["E"]).max(axis=1)
    assert (moved[np.unique(doc[:-1])] > 0).all()


def test_parameters_round_trip():
    _, _, p = small()
    again = gru.views(gru.packed(p))
    assert all((p[k] == again[k]).all() for k in p)


@pytest.mark.parametrize("keys", [[], [5], [0, 2**64 - 1], [7 << 45, (7 << 45) + 1, (7 << 45) + 9, (8 << 45) - 1, 8 << 45], "random"])
def test_places_of_words_among_the_keys(keys):
    """Keys of equal leading bits, the least and the greatest, and words beside them."""
    random = np.random.default_rng(5)
    keys = np.unique(random.integers(0, 2**64, 70000, dtype=np.uint64)) if keys == "random" else np.array(keys, np.uint64)
    words = np.concatenate([keys, keys + np.uint64(1), keys - np.uint64(1), random.integers(0, 2**64, 1000, dtype=np.uint64)])
    found = L.Vocabulary(keys, keys, keys, None, None, np.zeros(0), 0, 0).places(words)
    at = {int(k): i for i, k in enumerate(keys)}
    assert found.tolist() == [at.get(int(w), -1) for w in words]


@pytest.mark.parametrize("size", [1, 40])
def test_states_are_the_same_with_and_without_the_steps_kept(size):
    """Against gates written out; large weights bring gates and candidates to their ends. What scoring leaves out is one step's, not a window's."""
    random = np.random.default_rng(size)
    p = {k: v.astype(float) * size for k, v in gru.start(gru.Output.of(np.zeros(gru.WORDS, int)), np.ones(gru.CODES)).items()}
    read, new = random.integers(0, gru.CODES, (9, 5)).astype(np.int32), random.random((9, 5)) < 0.2
    h, S, logistic = random.normal(size=(gru.STATE, 5)), gru.STATE, lambda x: 1 / (1 + np.exp(-x))
    full, brief = gru.recurrence(p, read, new, h), gru.recurrence(p, read, new, h, kept=False)
    assert [len(x) for x in full] == [9] * 4 and [len(x) for x in brief] == [1, 1, 1, 9]
    with np.errstate(over="ignore"):
        for k in range(9):
            h = h * ~new[k]
            a, u = p["W"].T @ p["E"][read[k]].T + p["b"][:, None], p["R"].T @ h
            z, r = logistic(a[:S] + u[:S]), logistic(a[S : 2 * S] + u[S : 2 * S])
            h = z * h + (1 - z) * np.tanh(a[2 * S :] + r * u[2 * S :])
            assert np.allclose(full[3][k], h, atol=1e-12) and np.allclose(brief[3][k], h, atol=1e-12)
