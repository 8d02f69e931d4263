import re
from collections import defaultdict

from skeinwork.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, weights, most=3):
    """Shares by weight, capped; the excess is shared again until none is above."""
    total, held = sum(sizes), set()
    while True:
        rest = total - sum(most * sizes[i] for i in held)
        w = sum(weights[i] for i in range(len(sizes)) if i not in held)
        target = [most * s if i in held else rest * weights[i] / w if w else 0 for i, s in enumerate(sizes)]
        over = {i for i, t in enumerate(target) if t > most * sizes[i] + 1e-9} - held
        if not over:
            return target
        held |= over


def docs_of(make, prose, edges):
    items = [(k, prose(10 + k % 7, k), "abc"[k % 3] if k % 10 else None) for k in range(120)]
    items += [(200 + k, prose(3, k), "tiny") for k in range(3)] + [(300 + k, t, "edge") for k, t in enumerate(edges)]
    return items, make(items)


def test_targets_and_budgets(make, prose, edges):
    items, docs = docs_of(make, prose, edges)
    got = M.mix(docs, buckets=8).select("doc_id", "size", "source_size", "target", "taken").collect()
    size = {k: len(WORD.findall(t or "")) for k, t, _ in items}
    by = defaultdict(int)
    for k, _, s in items:
        by[s] += size[k]
    names = sorted(s for s in by if s) + [None]
    want = dict(zip(names, water([by[n] for n in names], [1 + i % 3 for i in range(len(names))]), strict=True))
    source, taken = {k: s for k, _, s in items}, defaultdict(int)
    assert len(got) == len(items)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == by[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[n] - want[n]) <= 0.5 + 1e-6 for n in names)


def test_reruns_and_partitions_agree(make, prose, edges):
    _, docs = docs_of(make, prose, edges)
    one, two = (sorted(M.mix(d, buckets=b).select("doc_id", "taken").collect()) for d, b in ((docs, 8), (docs.repartition(7), 64)))
    assert one == two
    assert one != sorted(M.mix(docs, seed=1).select("doc_id", "taken").collect())


def test_mixed_documents_hold_the_words_taken(make, prose, edges):
    items, docs = docs_of(make, prose, edges)
    out = M.mixed_documents(docs, buckets=8)
    assert out.columns == docs.columns
    words, texts = defaultdict(int), dict((k, t) for k, t, _ in items)
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        assert all(r[c] == "x" for c in docs.columns[5:])
    assert dict(words) == {r.doc_id: r.taken for r in M.mix(docs, buckets=8).collect() if r.taken}


def test_repeated_rows_ties_and_empty(make):
    docs = make([(1, "a b c", "s"), (1, "a b c", "s"), (1, "d", "s"), (None, "e f", "t"), (None, None, "t")])
    got = M.mix(docs).collect()
    assert len(got) == 5 and sum(r.taken for r in got) == sum(r["size"] for r in got)
    assert M.mix(make([])).collect() == [] and M.mixed_documents(make([])).collect() == []
    assert [r.taken for r in M.mix(make([None, ""])).collect()] == [0, 0]


def test_main_path_is_native(make):
    plan = M.mix(make(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
