"""Personal data: offset-preserving deobfuscation before detection.

Detectors for e-mail addresses, IP addresses, card and phone numbers run on the text as it is (base spans), then on a normalised form made by
three transducers: look-alike characters to ASCII, spelled-out digits to digits, and written-out "at" / "dot" to signs. Each transducer
keeps the places of its edits before and after them, so what is found maps back, pass by pass, to spans of the source. Such a
span is added unless a base span of its kind covers it wholly: a base span may be a mere fragment of what the normalised form shows.

Edge cases: null and empty texts have no spans; texts are searched whole, with patterns that take linear time; spans of different kinds may
overlap; repeated rows get equal spans; an empty table gives an empty result; extra columns are not read. Counts are of base spans;
``n_added`` counts what the normalised form adds.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import text_batches, tidied

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# Within a run of digits no later start can succeed where the first fails, hence the lookbehind.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

# Letters of other scripts that look like the ASCII letter they stand for.
LOOKS_LIKE = {
    "a": "аαɑ", "b": "ЬƄ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іιı", "j": "јϳ", "k": "κ", "l": "ӏ", "m": "м", "n": "ո",
    "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "т", "u": "υս", "v": "νѵ", "w": "ԝѡ", "x": "хχ", "y": "уγү", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙӀ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ",
    "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ",
    "@": "﹫＠", ".": "․。｡．", "-": "‐‑‒–—―−﹣－", "+": "﹢＋", " ": "           　",
    "": "­​‌‍⁠﻿",
}
# The digits' names in the languages of the documents.
DIGIT_WORDS = (
    ("zero", "zéro", "null", "cero"), ("one", "un", "eins", "uno"), ("two", "deux", "zwei", "dos"), ("three", "trois", "drei", "tres"),
    ("four", "quatre", "vier", "cuatro"), ("five", "cinq", "fünf", "cinco"), ("six", "six", "sechs", "seis"),
    ("seven", "sept", "sieben", "siete"), ("eight", "huit", "acht", "ocho"), ("nine", "neuf", "neun", "nueve"),
)
FOLD = {c: to for to, many in LOOKS_LIKE.items() for c in many} | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
FOLDED = re.compile("[" + re.escape("".join(FOLD)) + "]|(?![0-9])\\d")
WORD_DIGIT = {w: str(d) for d, words in enumerate(DIGIT_WORDS) for w in words}
_ONE = "(?:" + "|".join(sorted(WORD_DIGIT, key=lambda w: (-len(w), w))) + ")"
#: At least this many spelled digits in a row, of at least so many different ones where neither a dot nor a plus is said: ordinary prose has fewer.
LEAST_SPELLED, LEAST_DIFFERENT = 3, 3
_GAP = "(?:[ ,-]{1,2}| {1,3}dot {1,3})"
SPELLED = re.compile(rf"(?<!\w)(?:plus[ -]+)?{_ONE}(?:{_GAP}(?:{_ONE}|[0-9](?![0-9])))+(?!\w)", re.I)
MAYBE_SPELLED = re.compile(rf"(?:[ -]|\A){_ONE}{_GAP}{_ONE}(?!\w)", re.I)
BRACKETED_AT = re.compile(r" {0,3}[\[({<] {0,3}(?:at|@) {0,3}[\])}>] {0,3}", re.I)
BRACKETED_DOT = re.compile(r" {0,3}[\[({<] {0,3}(?:dot|\.|punkt|point|punto) {0,3}[\])}>] {0,3}", re.I)
WORDED_DOT = re.compile(r"(?<=[A-Za-z0-9-]) {1,3}dot {1,3}(?=[A-Za-z0-9])", re.I)
WORDED_AT = re.compile(r"(?<=[A-Za-z0-9_%+-]) {1,3}at {1,3}(?=[A-Za-z0-9-]+(?: {1,3}dot {1,3}| {0,3}[\[({<] {0,3}dot)[A-Za-z0-9\])}>])", re.I)
PLAIN_AT = re.compile(r" {1,3}at {1,3}(?=[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.(?:[a-z]{2,}|[A-Z]{2,})(?![A-Za-z0-9]))")
MAILBOX = re.compile(r"(?=[0-9._%+-]*[A-Za-z])[A-Za-z0-9]+(?:[._%+-]+[A-Za-z0-9]+)+|[A-Za-z]+[0-9]+")
# Words that invite to write to an address.
INVITES = re.compile(r"(?<![A-Za-z])(?:e-?mail|mail|write|contact|reach)(?: to)?:? {1,3}\Z", re.I)
MAYBE_SIGN = re.compile(r"(?<= )dot | at {1,3}[A-Za-z0-9.-]*\.[A-Za-z]{2}|[\[({<] {0,3}(?:at|@|dot|\.|punkt|point|punto) {0,3}[\])}>]", re.I)

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) << (k & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: looks left and right of each @ instead of trying every start."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield start, done
        at = text.find("@", done)


def detect(text: str) -> list[Span]:
    spans = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(spans)


class Tape:
    """A text under rewriting. Every pass leaves the places of its edits, before and after it; what it leaves as it is takes no memory."""

    def __init__(self, text: str) -> None:
        self.text, self.layers = text, []

    def rewrite(self, edits: Iterable[tuple[int, int, str]]) -> None:
        """``edits``: start, end and new text, in order and apart."""
        text, last, at = [], 0, 0
        old_start, old_end, new_start, new_end = (array("q") for _ in range(4))
        for a, b, new in edits:
            text += (self.text[last:a], new)
            at += a - last
            old_start.append(a)
            old_end.append(b)
            new_start.append(at)
            at, last = at + len(new), b
            new_end.append(at)
        if old_start:
            self.text = "".join([*text, self.text[last:]])
            self.layers.append((old_start, old_end, new_start, new_end))

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The span of the source that a span (not empty) of the text as it is now stands for."""
        for old_start, old_end, new_start, new_end in reversed(self.layers):
            i, j = bisect_right(new_start, start) - 1, bisect_right(new_start, end - 1) - 1
            if i >= 0:
                start = old_start[i] if start < new_end[i] else old_end[i] + start - new_end[i]
            if j >= 0:
                end = old_end[j] if end - 1 < new_end[j] else old_end[j] + end - new_end[j]
        return start, end


def digits_of(run: str) -> str | None:
    """The digits of a spelled run, with its sign; None if it looks like prose."""
    words = re.split(r"[ ,-]+", run.lower())
    plus = words[0] == "plus"
    digits = "".join("." if w == "dot" else WORD_DIGIT.get(w, w) for w in words[plus:])
    spelled = sum(w in WORD_DIGIT for w in words)
    told = plus or "." in digits  # what is no address or number then is left to the detectors
    return ("+" * plus + digits) if spelled >= LEAST_SPELLED and (told or len({*digits}) >= LEAST_DIFFERENT) else None


def worded_signs(text: str) -> Iterator[tuple[int, int, str]]:
    """An "at" before a domain with plain dots: prose has that too ("look at example.com"), so what stands before it must look like a mailbox, or the
    word before that must ask to write there."""
    for m in PLAIN_AT.finditer(text):
        start = m.start()
        while start and text[start - 1] in LOCAL:
            start -= 1
        box = text[start : m.start()]
        if MAILBOX.fullmatch(box) or (box and INVITES.search(text, max(0, start - 20), start)):
            yield m.start(), m.end(), "@"


def normalise(text: str) -> Tape | None:
    """The normalised form, or None where no transducer has anything to do."""
    fold, spelled, sign = FOLDED.search(text), MAYBE_SPELLED.search(text), MAYBE_SIGN.search(text)
    if not (fold or spelled or sign):
        return None
    tape = Tape(text)
    if fold:
        tape.rewrite((m.start(), m.end(), FOLD[m[0]] if m[0] in FOLD else str(int(m[0]))) for m in FOLDED.finditer(text))
    if fold or spelled:
        tape.rewrite((m.start(), m.end(), digits) for m in SPELLED.finditer(tape.text) if (digits := digits_of(m[0])))
    tape.rewrite((m.start(), m.end(), "@") for m in WORDED_AT.finditer(tape.text))
    tape.rewrite(worded_signs(tape.text))
    tape.rewrite((m.start(), m.end(), "@") for m in BRACKETED_AT.finditer(tape.text))
    tape.rewrite((m.start(), m.end(), ".") for m in BRACKETED_DOT.finditer(tape.text))
    if "@" in tape.text or DIGIT.search(tape.text):
        tape.rewrite((m.start(), m.end(), ".") for m in WORDED_DOT.finditer(tape.text))
    return tape if tape.layers else None


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that the normalised form adds."""
    base = detect(text)
    tape = normalise(text)
    if tape is None:
        return base, []
    # base spans of a kind are in order and apart: the last one that doesn't start later is the only one that can cover a span
    known = [[(a, b) for a, k, b in base if k == kind] for kind in range(len(KINDS))]
    added = set()
    for a, kind, b in detect(tape.text):
        start, end = tape.source(a, b)
        at = bisect_right(known[kind], (start, len(text)))
        if not at or known[kind][at - 1][1] < end:
            added.add((start, kind, end))
    return base, sorted(added)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def scan(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every document."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, added = find(text.as_py() or "")
                counts = [sum(k == n for _, k, _ in base) for n in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(base + added)), len(added)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), SCHEMA)


def redact(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans are replaced together, by the first one's kind."""
    base, added = find(text)
    out, end = [], 0
    for a, kind, b in sorted(base + added):
        if a >= end:
            out += [text[end:a], f"<{KINDS[kind].upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redacted_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data redacted and, where there is such a column, n_chars counted anew."""
    text_batches(docs.sparkSession)
    names = docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redact(t) for t in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = docs.mapInArrow(tidied(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*names) if "n_chars" in names else out
