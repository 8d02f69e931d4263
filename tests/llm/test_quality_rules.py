import random
import re
from collections import Counter

import zstandard

from skeinwork.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = list(zip(words, words[1:], words[2:], strict=False))
    twice, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if twice[g] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    data, press, bands = text.encode(), zstandard.ZstdCompressor(level=3), Q.Bands()
    kept = False
    if data and not failed:
        ratio = len(press.compress(data)) / len(data)
        low, high = next((a, b) for n, a, b in bands.whole if len(data) < n)
        parts = [data[i : i + bands.chunk] for i in range(0, len(data), bands.chunk)] if len(data) >= bands.chunk else []
        out = 0
        for part in parts:
            few = bands.chunks if len(part) == bands.chunk else next((a, b) for n, a, b in bands.whole if len(part) < n)
            out += not few[0] <= len(press.compress(part)) / len(part) <= few[1]
        kept = low <= ratio <= high and out / max(len(parts), 1) <= bands.outside
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed, kept


def test_against_brute_force(make, prose, edges):
    texts = [*edges, *(prose(n, n) for n in (10, 49, 50, 51, 300, 3000)), prose(80, 1) + "\n" + prose(80, 1), "l1\nl1\n \nl1\nl2\tx\nl2\tx", "one two three four " * 40, "### a|b <c> %" * 30, "é ü 日本　語 " * 60]
    got = Q.assess(make([*texts, texts[8], texts[8]])).collect()
    assert len(got) == len(texts) + 2
    for r, text in zip(sorted(got, key=lambda r: r.doc_id), [*texts, texts[8], texts[8]], strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == brute(text), text and text[:40]


def test_local_junk_counts_wherever_it_stands(make):
    """Long texts of plain prose with a share of noise or of repetition; the whole ratio alone would pass the mixtures."""
    r = random.Random(4)
    syllable = lambda: r.choice("bcdfghklmnprstvz") + r.choice("aeiou") + r.choice(["", "", "n", "s", "r", "l"])
    words = lambda n: " ".join("".join(syllable() for _ in range(r.randint(1, 3))) for _ in range(n))
    noise = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    good = words(2500)
    texts = [good, good + " " + noise(int(0.42 * len(good))), good[: len(good) // 2] + " " + noise(len(good) // 2), words(1500) + " xy" * 2000, good + " " + noise(400)]
    got = {x.doc_id: x for x in Q.assess(make(texts)).collect()}
    assert [got[k].kept for k in range(5)] == [True, False, False, False, True]
    assert 0.3 <= got[1].ratio <= 0.65


def test_good_and_bad_labels(spark):
    """What the bands cost and catch among labelled documents."""
    tables = "/root/testdata/sf0.01"
    found = Q.assess(spark.read.parquet(f"{tables}/documents.parquet")).join(spark.read.parquet(f"{tables}/labels.parquet"), "doc_id").collect()
    share = lambda q: sum(r.kept for r in found if r.quality == q) / sum(r.quality == q for r in found)
    assert share(1) > 0.9 and share(0) < 0.5


def test_stage_keeps_columns_and_agrees(make, prose):
    docs = make([prose(200, k) for k in range(8)] + ["spam " * 300, None])
    kept = Q.kept_documents(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in Q.assess(docs).where("kept").collect()} and kept.where("doc_id > 7").count() == 0


def test_empty_table(make):
    assert Q.assess(make([])).collect() == [] and Q.kept_documents(make([])).collect() == []
