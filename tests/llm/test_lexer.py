import re

import numpy as np
import pyarrow as pa
import pytest

from skeinwork.llm import lexer
from skeinwork.llm.common import blocks, text_views

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["The the THE end", "", None, " \t\n", "é É Straße", "a" * 300 + " b", "x y\x0bz\x0c", "日本　語 \x85q", "the"] * 5


@pytest.mark.parametrize("segment", [1, 7, 64, 1 << 20])
def test_words_and_hashes(monkeypatch, segment):
    monkeypatch.setattr(lexer, "SEGMENT", segment)
    raw, offsets = text_views(pa.array(TEXTS))
    found = lexer.lex(raw, offsets)
    words = [(k, w) for k, t in enumerate(TEXTS) for w in WORD.findall(t or "")]
    assert [(d, bytes(found.data[a:b]).decode()) for d, a, b in zip(found.doc, found.start, found.end, strict=True)] == words
    for lower in (True, False):
        names = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if lower else w for _, w in words]
        hashes = found.hashes(lower).tolist()
        assert len(set(zip(names, hashes, strict=True))) == len(set(names)) == len(set(hashes))
        monkeypatch.setattr(lexer, "SEGMENT", 1 << 20)
        assert hashes == found.hashes(lower).tolist()
        monkeypatch.setattr(lexer, "SEGMENT", segment)


def test_windows_stay_within_a_text():
    raw, offsets = text_views(pa.array(["a b c", "a b", "", "b c d e"]))
    found = lexer.lex(raw, offsets)
    _, at = lexer.windows(found.hashes(True), found.doc, 3)
    assert at.tolist() == [0, 5, 6]
    assert len(lexer.windows(found.hashes(True)[:2], found.doc[:2], 3)[0]) == 0


def test_blocks_cover_all_rows():
    offsets = np.array([0, 10, 10, 500, 501, 502, 900])
    assert list(blocks(offsets, 100)) == [(0, 2), (2, 3), (3, 5), (5, 6)]
    assert list(blocks(np.array([0]))) == []


def test_views_of_slices_and_nulls():
    for column in (pa.array(["ab", None, "c"]).slice(1), pa.chunked_array([["ab"], [None, "c"]]).slice(1), pa.array(["ab", None, "c"], pa.large_string()).slice(1)):
        raw, offsets = text_views(column)
        assert bytes(raw) == b"c" and offsets.tolist() == [0, 0, 1]
