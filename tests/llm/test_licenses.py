import random

import pytest

from skeinwork.llm import licenses as L
from skeinwork.llm.license_texts import TEMPLATES


def found(make, texts, **k):
    return [(r.doc_id, r.license, r.coverage, r.span_start, r.span_end) for r in sorted(L.scan(make(texts), **k).collect(), key=lambda r: (r.doc_id, r.span_start))]


@pytest.mark.parametrize("name", TEMPLATES)
def test_every_template_is_found_whole(make, prose, name):
    text = f"é {prose(40, 1)}\n{TEMPLATES[name]}\n{prose(30, 2)}"
    got = found(make, [text])
    assert [(g[1], g[2]) for g in got] == [(name, 1.0)]
    assert TEMPLATES[name].strip('."').startswith(text[got[0][3] : got[0][4]][:20]) and text[got[0][3] : got[0][4]].rstrip("./") == TEMPLATES[name].rstrip("./")


def test_edited_text_is_aligned(make, prose):
    words = TEMPLATES["MIT"].split()
    r = random.Random(3)
    for k in sorted(r.sample(range(len(words)), 12)):
        words[k] = r.choice(["other", "", "two words"])
    got = found(make, [prose(20, 5) + " " + " ".join(words) + " " + prose(20, 6)])
    assert [g[1] for g in got] == ["MIT"] and 0.85 < got[0][2] < 1


def test_parts_and_repeats(make, prose):
    half = " ".join(TEMPLATES["Apache-2.0 header"].split()[:40])
    notice = TEMPLATES["MIT notice"]
    assert [g[1] for g in found(make, [half])] == ["Apache-2.0 notice"]
    assert [g[:2] for g in found(make, [f"{notice}\n{prose(50, 1)}\n{notice}", notice])] == [(0, "MIT notice")] * 2 + [(1, "MIT notice")]
    assert [g[1] for g in found(make, [TEMPLATES["GPL-3.0 notice"]])] == ["GPL-3.0 notice"]


@pytest.mark.parametrize("joint", ["\n", "\n\n// ", " "])
def test_short_notices_on_successive_lines_are_each_reported(make, prose, joint):
    names = [n for n in TEMPLATES if "notice" in n or n == "All rights reserved"]
    texts = [f"é {prose(9, 1)}\n{joint.join([TEMPLATES[n]] * 40)}\n{prose(9, 2)}" for n in names]
    got = found(make, texts)
    for k, name in enumerate(names):
        spans = [(a, b) for doc, license, share, a, b in got if doc == k and (license, share) == (name, 1.0)]
        assert len(spans) == 40 == sum(g[0] == k for g in got)
        assert all(texts[k][a:b] == TEMPLATES[name].rstrip(".") for a, b in spans)


def test_edited_and_mixed_lines_in_a_run(make):
    mit, rights = TEMPLATES["MIT notice"], TEMPLATES["All rights reserved"]
    lines = [mit, mit.replace("the ", ""), mit, rights, "Released under", mit, rights, rights, TEMPLATES["GPL-2.0 notice"], TEMPLATES["GPL-3.0 notice"], TEMPLATES["GPL-2.0 notice"]]
    got = found(make, ["\n".join(lines)])
    want = ["MIT notice", "MIT notice", "MIT notice", "All rights reserved", "MIT notice", "All rights reserved", "All rights reserved", "GPL-2.0 notice", "GPL-3.0 notice", "GPL-2.0 notice"]
    assert [g[1] for g in got] == want and [g[2] for g in got] == [1.0, 0.8] + [1.0] * 8


@pytest.mark.parametrize("text, want", [
    ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0 notice"]), ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0 notice"]), ("Licensed under CC BY 3.0.", []),
    ("This work is licensed under the GNU General Public License, version 1.", []), ("this work is licensed under the GNU Lesser General Public License, version 3", ["LGPL-3.0 notice"]),
    ("This work is licensed under the GNU Library General Public License, version 2.", []), ("// SPDX-License-Identifier: LGPL-2.1-or-later", ["LGPL-2.1-or-later tag"]),
    ("# SPDX-License-Identifier: Apache-2.0", ["Apache-2.0 tag"]), ("Licensed under the Apache License, Version 1.1.", []), ("Licensed under CC NC 4.0", []),
])
def test_words_that_decide(make, text, want):
    assert [g[1] for g in found(make, [f"so {text} so"])] == want


def full_alignment(template, text):
    """Smith-Waterman without a band: the best score, then the most matches, over all ends."""
    none = (0, 0)
    before, best = [none] * (len(template) + 1), none
    for word in text:
        row = [none]
        for i, mine in enumerate(template):
            s, m = before[i]
            cell = (s + L.MATCH, m + 1) if word == mine else (s + L.MISMATCH, m)
            row.append(max(cell, (row[-1][0] + L.GAP, row[-1][1]), (before[i + 1][0] + L.GAP, before[i + 1][1]), none))
        before, best = row, max(best, *row)
    return best


@pytest.mark.parametrize("seed", range(60))
def test_alignment_against_the_full_matrix(seed):
    r = random.Random(seed)
    template = [r.randrange(30) for _ in range(r.randint(6, 25))]
    planted = []
    for w in template:  # changed, lost and added words
        planted += r.choice([[w]] * 12 + [[r.randrange(100)], [], [w, r.randrange(100)]])
    text = [100 + r.randrange(50) for _ in range(r.randint(0, 30))]
    at = r.randint(0, len(text))
    text[at:at] = planted
    got = max((x[:2] for x in L.alignments(template, text, at, L.BAND, 1)), default=(0, 0))
    assert got == full_alignment(template, text)


def test_repetitive_text_is_no_long_work(make):
    import time

    began = time.time()
    texts = ["permission is hereby granted free of charge " * 6000, "licensed under the " * 12000, "the software is provided as is without warranty of any kind " * 4000]
    assert found(make, texts) == [] and time.time() - began < 15


def test_long_runs_take_linear_time(make):
    got = found(make, ["Released under the MIT License.\n" * 1000, "All rights reserved.\n" * 20000, TEMPLATES["MIT"] + "\n" + TEMPLATES["MIT"]])
    assert [sum(g[0] == k for g in got) for k in range(3)] == [1000, 20000, 2]


def test_clean_and_edge_texts(make, prose, edges):
    assert found(make, [*edges, prose(3000, 8), "the software is provided to you", "all rights", "reserved rights all"]) == []
    assert found(make, []) == []


def test_winnowing_meets_its_guarantee():
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(200):
        shared = r.integers(0, 1000, L.WINDOW).astype(np.uint64)
        kept = []
        for _ in range(2):
            g = np.concatenate([r.integers(0, 1000, r.integers(0, 5)), shared, r.integers(0, 1000, r.integers(0, 5))]).astype(np.uint64)
            kept.append({int(g[k]) for k in L.winnow(g, np.zeros(len(g), int))})
        assert kept[0] & kept[1] & {int(x) for x in shared}
