"""Personal data in texts, plain or disguised.

Plain identifiers are found on the text as it is. Disguised ones are found on a
normalised copy: transducers turn look-alike letters, spelled digits and written-out
"at" and "dot" into what they stand for, and keep, for each stretch they changed, where
it was in the source. What is found there is mapped back to source characters.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.llm._shared import arrow_map

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits that fails from its first digit fails from the others too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKE = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝɡɑοανρικτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧℓ",
        "ABESIJKMHOPCTYXaesijopcyxhdqwgaoavpiktuxABEZHIKMNOPTYXl",
        strict=True,
    )
)
#: Characters without width.
NO_WIDTH = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


def _plain(letter: str) -> str | None:
    """The ASCII character that a character stands for, "" if none is seen, or None."""
    if letter in LOOK_ALIKE:
        return LOOK_ALIKE[letter]
    if letter in NO_WIDTH:
        return ""
    if (digit := unicodedata.decimal(letter, None)) is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", letter)
    return folded if len(folded) == 1 and folded.isascii() and folded.isprintable() and folded != " " else None


_GLYPHS = {c: p for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x20000)]) if (p := _plain(c)) is not None}
#: Neither ASCII nor one of the usual letters with accents: only such characters can be in _GLYPHS.
_UNUSUAL = re.compile("[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u017e]")
_D = "(?:" + "|".join(DIGIT_WORDS) + ")"
_SPELLED = re.compile(rf"(?<![a-z0-9])(?:plus[ ,-]+)?(?:{_D}|[0-9]+)(?:[ ,.-]+(?:dot[ ]+|point[ ]+)?(?:{_D}|[0-9]+)){{3,}}(?![a-z0-9])")
_SPELLED_PART = re.compile(rf"plus|dot|point|{_D}|[0-9]+|[ ,.-]+")
# A run of blanks is tried from its first one only.
_AT = re.compile(r"(?:(?<!\s)\s++)?[\[({<]\s*+(?:at|@|arroba|arobase)\s*[\])}>]\s*|(?<=[a-z0-9])\s+(?:at|arroba|arobase)\s+(?=[a-z0-9])", re.I)
_DOT = re.compile(r"(?:(?<!\s)\s++)?[\[({<]\s*+(?:dot|\.|punkt|punto|point)\s*[\])}>]\s*|(?<=[a-z0-9])\s+(?:dot|punkt|punto)\s+(?=[a-z0-9])", re.I)
#: Last labels of an address whose "at" is a bare word, and words before it that are no names.
TOP_LEVEL = frozenset("com org net edu gov int mil info biz name io co ai app dev me tv us uk de fr es it nl be ch at eu ca au nz in jp cn br mx ru pl se no fi dk pt ie".split())
NO_NAMES = frozenset("look looked looking looks arrive arrived arrives arriving meet meeting met stay stayed live lived work worked working works start started begin began buy bought shop see saw seen find found read order ordered sign stop is are was were be been it that this and or not back here there them us you me".split())
#: One of these is in every stretch that stands for "at" or "dot" and counts as a disguise: a bare "at" does not.
_HINTS = ("[", "(", "{", "<", "dot", "punkt", "punto")
#: One of these is in every run of spelled digits that counts: digits and gaps alone do not.
_WORDS = (*DIGIT_WORDS, "plus", "dot", "point")


def emails(text: str) -> list[tuple[int, int]]:
    """Found from each @ backwards, so that long words without one cost nothing."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        low = at + 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            low = domain.end()
            out.append((start, low))
        at = text.find("@", low)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of identifiers as they stand, leftmost and without overlap for each kind."""
    out = [(*m, "email") for m in emails(text)] if "@" in text else []
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p) < 1000 and int(p) <= 255 for p in m[0].split(".")):
                out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 38:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return out


@dataclass
class Copy:
    """A normalised text; changed stretches by their start in it: (source start, source end, what was done)."""

    text: str
    starts: list[int]
    changed: list[tuple[int, int, int, str]]  # start and end in the copy, shift to the source after it, kind
    sources: list[tuple[int, int]]

    @classmethod
    def of(cls, text: str, edits: list[tuple[int, int, str, str]]) -> Copy:
        """edits: (start, end, new, kind) in order, without overlap."""
        parts, at, size, copy = [], 0, 0, cls("", [], [], [])
        for start, end, new, kind in edits:
            parts += [text[at:start], new]
            size += start - at
            copy.starts.append(size)
            size += len(new)
            copy.changed.append((copy.starts[-1], size, end - size, kind))
            copy.sources.append((start, end))
            at = end
        copy.text = "".join([*parts, text[at:]])
        return copy

    def source(self, start: int, end: int) -> tuple[int, int, set[str]]:
        """Where [start, end) came from, and what was done within it."""
        i = bisect_right(self.starts, start) - 1
        while i > 0 and self.changed[i - 1][1] > start:
            i -= 1
        first, last, kinds = None, None, set()
        if i >= 0 and self.changed[i][0] <= start < self.changed[i][1]:
            first = self.sources[i][0]
        else:
            first = start + (self.changed[i][2] if i >= 0 else 0)
        j = bisect_right(self.starts, end - 1) - 1
        if j >= 0 and self.changed[j][1] >= end and self.changed[j][0] < end:
            last = self.sources[j][1]
        else:
            last = end + (self.changed[j][2] if j >= 0 else 0)
        for k in range(max(0, i), j + 1):
            if self.changed[k][0] < end and self.changed[k][1] > start or start < self.changed[k][0] < end:
                kinds.add(self.changed[k][3])
        return first, last, kinds


def _glyph_edits(text: str) -> list[tuple[int, int, str, str]]:
    return [(m.start(), m.end(), _GLYPHS[m[0]], "glyph") for m in _UNUSUAL.finditer(text) if m[0] in _GLYPHS]


def _spelled_edits(text: str) -> list[tuple[int, int, str, str]]:
    out = []
    for run in _SPELLED.finditer(text):
        items = list(_SPELLED_PART.finditer(text, run.start(), run.end()))
        for item in items:
            word = item[0]
            if word in DIGIT_WORDS:
                out.append((item.start(), item.end(), str(DIGIT_WORDS.index(word)), "digit"))
            elif word == "plus":
                out.append((item.start(), item.end(), "+", "digit"))
            elif word in ("dot", "point"):
                out.append((item.start(), item.end(), ".", "digit"))
            elif not word[0].isdigit():
                out.append((item.start(), item.end(), "." if word.strip() == "." else "", "gap"))
    return out


def _word_edits(text: str) -> list[tuple[int, int, str, str]]:
    found = [(m.start(), m.end(), "@", "at" if m[0].strip()[0] in "[({<" else "bare at") for m in _AT.finditer(text)]
    found += [(m.start(), m.end(), ".", "dot") for m in _DOT.finditer(text)]
    return _apart(found)


_GLUED = re.compile(rf"(?<=[a-z0-9])[ -]+{_D}(?:[ -]+{_D})*$")
_GLUED_PART = re.compile(rf"{_D}|[ -]+")


def _glue_edits(low: str, marks: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Spelled digits right before an "at", joined to the word before them."""
    out = []
    for start, _, new, _ in marks:
        if new == "@" and (m := _GLUED.search(low, max(0, start - 80), start)):
            for part in _GLUED_PART.finditer(low, m.start(), m.end()):
                out.append((part.start(), part.end(), str(DIGIT_WORDS.index(part[0])) if part[0] in DIGIT_WORDS else "", "glued"))
    return out


def _apart(edits: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """In order, without those that overlap one before."""
    out, at = [], 0
    for edit in sorted(edits):
        if edit[0] >= at:
            out.append(edit)
            at = edit[1]
    return out


def _counts(kind: str, done: set[str], found: str) -> bool:
    """Whether what was undone in a span makes it a disguise of that kind; bare words alone need a likely address."""
    if kind != "email":
        return bool(done & {"glyph", "digit", "dot"})
    if "bare at" in done and "at" not in done and "glyph" not in done:
        return "dot" in done and found.rpartition(".")[2].lower() in TOP_LEVEL and found.partition("@")[0].lower() not in NO_NAMES
    return bool(done & {"glyph", "at", "dot"})


def disguised_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in the source of identifiers that appear only once disguises are undone."""
    out: list[tuple[int, int, str]] = []
    base, glyphs = text, None
    if not text.isascii() and (edits := _glyph_edits(text)):
        glyphs = Copy.of(text, edits)
        base = glyphs.text
        for start, end, kind in plain_spans(base):
            first, last, done = glyphs.source(start, end)
            if done:
                out.append((first, last, kind))
    low = base.lower()
    if len(low) != len(base):  # places must stay: letters whose lower case is longer are kept
        low = "".join(x if len(x := c.lower()) == 1 else c for c in base)
    words = _word_edits(base) if any(hint in low for hint in _HINTS) else []
    digits = _spelled_edits(low) if any(word in low for word in _WORDS) else []
    glued = _glue_edits(low, words) if digits or any(word in low for word in DIGIT_WORDS) else []
    # each on its own, and all at once: what one of them finds, the others can't hide
    for edits in (words, digits, _apart([*words, *digits, *glued]) if words and (digits or glued) else []):
        if edits:
            copy = Copy.of(base, edits)
            for start, end, kind in plain_spans(copy.text):
                first, last, done = copy.source(start, end)
                if _counts(kind, done, copy.text[start:end]):
                    if glyphs:
                        first, last, _ = glyphs.source(first, last)
                    out.append((first, last, kind))
    return out


def all_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Plain spans, and all: the plain ones and those disguised ones that none of the same kind already covers."""
    order = {k: i for i, k in enumerate(KINDS)}
    key = lambda s: (s[0], order[s[2]], s[1])
    plain = sorted(plain_spans(text), key=key)
    more, high, at = [], dict.fromkeys(KINDS, -1), 0  # high: the furthest end so far, by kind, of what starts no later
    for start, end, kind in sorted(set(disguised_spans(text)), key=lambda s: (s[0], -s[1], s[2])):
        while at < len(plain) and plain[at][0] <= start:
            high[plain[at][2]] = max(high[plain[at][2]], plain[at][1])
            at += 1
        if end > high[kind]:
            more.append((start, end, kind))
            high[kind] = end
    return plain, sorted(plain + more, key=key)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row.

    Counts are of all spans, plain and disguised. Null and empty texts have none.
    Offsets are code points, ends exclusive. Repeated rows and null ids are rows like
    others; further columns are not read. Narrow, and linear in a text's length.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t or "") for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[2] == k for s in every) for _, every in found], pa.int64()) for k in KINDS]
            digests = pa.array([hashlib.sha256(_joined(plain).encode()).hexdigest() for plain, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, digests, pa.array([_joined(every) for _, every in found], pa.string())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, find, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
