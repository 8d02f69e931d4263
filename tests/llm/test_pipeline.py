"""The pipeline, stage by stage, against brute force over its own input; and the queries' contract."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from test_near_dedup import brute as groups
from test_near_dedup import edited, sets_of
from test_quality_rules import brute as rules
from test_tokens import layout

from skeinwork.llm import entry, pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n, seed):
    """Text of syllables enough that compression tells nothing against it."""
    r = random.Random(seed)
    syllable = lambda: r.choice("bcdfghklmnprstvz") + r.choice("aeiou") + r.choice(["", "", "n", "s", "r", "l"])
    return " ".join("".join(syllable() for _ in range(r.randint(1, 3))) for _ in range(n))


def test_stages_against_brute_force(make, spark, tmp_path):
    texts = [prose(70 + 3 * k, k) for k in range(30)]
    texts += [edited(t, 0.01, k) for k, t in enumerate(texts[:6])] + texts[2:5] + ["spam " * 200, None, "", prose(120, 500) + " mail x@y.zz or 1.2.3.4", "!! ".join(texts[3].split(" "))]
    docs = make([(k, t, "abc"[k % 3]) for k, t in enumerate(texts)], extra=False)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        rows = out.collect()
        if name == "quality rules":
            assert {r.doc_id for r in rows} == {k for k, t in seen.items() if rules(t)[-1]} and len(rows) < len(seen)
        elif name == "near dedup":
            ids = list(seen)
            assert {r.doc_id for r in rows} == set(groups(ids, sets_of([seen[i] for i in ids], 5)).values()) and len(rows) < len(seen)
        elif name == "personal data":
            assert {r.doc_id: r.text for r in rows} == {k: pii.redact(t) for k, t in seen.items()} and any("<EMAIL>" in r.text for r in rows)
        elif name == "mixing":
            size, source = Counter(), {r.doc_id: r.source for r in docs.collect()}
            taken, words = defaultdict(int), lambda t: len(WORD.findall(t))
            for k, t in seen.items():
                size[source[k]] += words(t)
            for r in rows:
                taken[r.source] += words(r.text)
                assert seen[r.doc_id].startswith(r.text)
            total = sum(size.values())
            assert all(abs(taken[s] - min(3 * size[s], total * (1 + i) / 6)) <= 0.02 * total for i, s in enumerate(sorted(size)))
        docs = spark.createDataFrame(rows, out.schema)
        seen = {r.doc_id: r.text for r in rows}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(seen)
    layout(packed, 2048)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole) == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)


COLUMNS = {
    1: ["doc_id", "held_out", "score", "predicted"], 2: ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"], 3: ["doc_id"],
    4: ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"], 5: ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    6: ["doc_id", "size", "source_size", "target", "taken"], 7: ["query_id", "rank", "vec_id", "score"], 8: ["doc_id", "n_shingles", "component_id", "kept"],
    9: ["doc_id", "start", "n_tokens", "ids_crc32"], 10: ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
}


TYPES = {
    "doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
    "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint",
    "offset": "bigint", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "size": "bigint", "source_size": "bigint", "target": "double",
    "taken": "bigint", "query_id": "bigint", "rank": "int", "vec_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "n_email": "bigint", "n_ip": "bigint",
    "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string",
}


def test_queries_have_the_columns_asked_for(spark):
    """In the order asked for, of the types asked for, more columns behind them."""
    assert [int(re.match(r"op(\d+)_", q)[1]) for q in entry.QUERIES] == list(range(1, 11)) and set(entry.ORACLES) <= set(entry.QUERIES)
    for name, q in entry.QUERIES.items():
        df, n = q(spark, "/root/testdata/sf0.001"), int(re.match(r"op(\d+)_", name)[1])
        assert df.columns[: len(COLUMNS[n])] == COLUMNS[n] and df.count() >= (0 if n == 3 else 1), name
        types = dict(df.dtypes) | ({"score": "double"} if n == 7 and dict(df.dtypes)["score"] == "bigint" else {})
        assert {c: types[c] for c in COLUMNS[n]} == {c: TYPES[c] for c in COLUMNS[n]}, name


def test_edges_through_all_stages(make, spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, ties, and columns that bear the operators' own names."""
    clean = [prose(90, 900 + k) for k in range(4)]
    items = [(None, clean[0]), (None, clean[0]), (None, None), (1, clean[1]), (1, clean[1]), (2, ""), (3, None), (4, "x" * 5000), (5, prose(6000, 77)), (6, clean[2], None), (7, clean[2], "t"), (8, clean[3], "")]
    docs = make(items)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows[name] = out.collect()
        assert all(r[c] == "x" for r in rows[name] for c in docs.columns[5:]), name
        docs = spark.createDataFrame(rows[name], out.schema)
    ids = {name: Counter(r.doc_id for r in found) for name, found in rows.items()}
    assert ids["quality rules"] == Counter({None: 2, 1: 2, 5: 1, 6: 1, 7: 1, 8: 1})
    assert ids["near dedup"] == Counter({None: 2, 1: 2, 5: 1, 6: 1, 8: 1})  # a repeated row is one document; null ids are linked with nothing
    assert ids["personal data"] == ids["near dedup"] and set(ids["mixing"]) <= set(ids["near dedup"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(ids["mixing"]) and max(r.piece for r in packed if r.doc_id == 5) > 0
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in whole) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_an_empty_table_through_all_stages(make, spark, tmp_path):
    make([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
