"""Token ids of whole texts by the tokenizers library, with a bounded memory of units already encoded.

The two vocabularies split a text into pieces before they merge bytes, and no piece reaches from a visible character into white space
that follows. So a text may be cut before each run of white space, and the ids of the parts are the ids of the whole. Units (a run of
ASCII white space and the word after it) repeat far more often than texts do: each worker keeps the ids of those it has met, found by
a 64-bit hash of the unit's bytes, and hands the library only new ones. Texts that hold white space outside ASCII are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np

from skeinwork.llm.lexer import lex

#: Units that a worker remembers before it starts anew, and the longest of them in bytes (longer ones are encoded each time).
MOST_UNITS, LONGEST = 2_500_000, 64
#: Stands between units that are encoded together: always a piece, and a token, of its own.
BETWEEN = " ~"
#: Units that are encoded together.
TOGETHER = 500
# UTF-8 forms of white space outside ASCII, and ASCII separators that only some libraries count as such.
WIDE_SPACES = [c.encode() for c in "\x1c\x1d\x1e\x1f\x85\xa0                　"]
_LEADS = np.zeros(256, bool)
_LEADS[[s[0] for s in WIDE_SPACES]] = True


def ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All indices of the ranges first .. first + size, and where each range begins among them (n + 1)."""
    begin = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=begin[1:])
    return np.repeat(first - begin[:-1], size) + np.arange(begin[-1]), begin


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.between = self.plain([BETWEEN])[0]
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.uint16)
        self.store, self.used = np.zeros(1 << 20, np.uint32), 0

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, joined, and the number of each unit's ids."""
        if len(self.between) != 1:
            each = self.plain(texts)
            return np.fromiter((i for x in each for i in x), np.uint32), np.array([len(x) for x in each], np.int64)
        sign = self.between[0]
        groups = [texts[i : i + TOGETHER] for i in range(0, len(texts), TOGETHER)]
        flat, sizes = [], []
        for group, ids in zip(groups, self.plain([BETWEEN.join(g) for g in groups]), strict=True):
            ids = np.array(ids, np.uint32)
            at = np.flatnonzero(ids == sign)
            if len(at) != len(group) - 1:  # a unit holds the sign itself
                each = self.plain(group)
                flat.append(np.fromiter((i for x in each for i in x), np.uint32))
                sizes.append(np.array([len(x) for x in each], np.int64))
                continue
            flat.append(np.delete(ids, at))
            sizes.append(np.diff(np.concatenate(([-1], at, [len(ids)]))) - 1)
        return np.concatenate(flat), np.concatenate(sizes)

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Keep the ids of new units; ``keys`` ascend."""
        joined = np.array([t[0].isspace() and not t.isspace() and "~" not in t for t in texts], bool)
        order = np.concatenate([np.flatnonzero(joined), np.flatnonzero(~joined)])
        ids, sizes = self.units([texts[k] for k in order[: joined.sum()]]) if joined.any() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        alone = self.plain([texts[k] for k in order[joined.sum() :]])
        ids = np.concatenate([ids, np.fromiter((i for x in alone for i in x), np.uint32)])
        sizes = np.concatenate([sizes, np.array([len(x) for x in alone], np.int64)])
        if self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store[: self.used], np.zeros(max(len(self.store), len(ids)), np.uint32)])
        self.store[self.used : self.used + len(ids)] = ids
        first, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[order], size[order] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.size = np.insert(self.keys, at, keys), np.insert(self.first, at, first.astype(np.uint32)), np.insert(self.size, at, size.astype(np.uint16))

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``raw``: UTF-8 bytes; ``offsets``: n + 1 places in it. Ids of all texts, one after the other (uint32), and bounds (n + 1)."""
        lexed = lex(raw, offsets)
        n, data = lexed.rows, lexed.data
        text_end = lexed.text_start[1:] - 1
        # a unit for each word, from the end of the word before it, and one for what follows a text's last word
        last = np.where(lexed.first[1:] > lexed.first[:-1], lexed.end[np.maximum(lexed.first[1:], 1) - 1] if len(lexed.end) else 0, lexed.text_start[:-1])
        start = np.concatenate(([0], lexed.end[:-1])) if len(lexed.end) else lexed.start
        heads = lexed.first[:-1][lexed.first[1:] > lexed.first[:-1]]
        start[heads] = lexed.text_start[lexed.doc[heads]]
        tails = np.flatnonzero(last < text_end)
        at = lexed.first[1:][tails]
        start, end = np.insert(start, at, last[tails]), np.insert(lexed.end, at, text_end[tails])
        row = np.insert(lexed.doc, at, tails)

        whole = self.wide_rows(lexed.data, lexed.text_start)
        memory = end - start <= LONGEST
        if len(whole):
            memory &= ~np.isin(row, whole)
        keys = lexed.span_hashes(start, end, lower=False)
        names, place, back = np.unique(keys[memory], return_index=True, return_inverse=True)
        if len(self.keys) > MOST_UNITS:
            self.forget()
        found = np.searchsorted(self.keys, names)
        new = np.ones(len(names), bool) if not len(self.keys) else self.keys[np.minimum(found, len(self.keys) - 1)] != names
        if new.any():
            one = np.flatnonzero(memory)[place[new]]
            view = memoryview(data)
            self.learn(names[new], [str(view[a:b], "utf-8") for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)])
            found = np.searchsorted(self.keys, names)
        first, size = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        first[memory], size[memory] = self.first[found[back]], self.size[found[back]]

        store, used = self.store, self.used
        view = memoryview(data)
        extra = [(k, str(view[start[k] : end[k]], "utf-8")) for k in np.flatnonzero(~memory & ~np.isin(row, whole))] if not memory.all() else []
        for r in whole:  # the first unit of such a text stands for all of it
            k = int(np.searchsorted(row, r))
            extra.append((k, str(view[lexed.text_start[r] : text_end[r]], "utf-8")))
        if extra:
            ids = self.plain([t for _, t in extra])
            flat = np.fromiter((i for x in ids for i in x), np.uint32)
            sizes = np.array([len(x) for x in ids], np.int64)
            spots = np.array([k for k, _ in extra])
            first[spots], size[spots] = used + np.cumsum(sizes) - sizes, sizes
            store = np.concatenate([store[:used], flat])
        index, begin = ranges(first, size)
        return store[index], begin[np.searchsorted(row, np.arange(n + 1))]

    @staticmethod
    def wide_rows(data: np.ndarray, text_start: np.ndarray) -> np.ndarray:
        """Rows that hold white space outside the units' separators."""
        lead = np.flatnonzero(_LEADS[data])
        if not len(lead):
            return lead
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        hit = np.zeros(len(lead), bool)
        for space in WIDE_SPACES:
            same = padded[lead] == space[0]
            for k in range(1, len(space)):
                same &= padded[lead + k] == space[k]
            hit |= same
        return np.unique(np.searchsorted(text_start, lead[hit], "right") - 1)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with one more id after each."""
    n = len(bounds) - 1
    after = bounds + np.arange(n + 1)
    out = np.full(len(ids) + n, end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[after[1:] - 1] = False
    out[keep] = ids
    return out, after
