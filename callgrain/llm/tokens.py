"""Token counts by byte-pair merging, without making identifiers.

A text is cut into pieces by the vocabulary's pattern. Each piece starts as one
symbol a byte in a linked list; a heap yields the adjacent pair of the lowest rank,
again and again, and each merge removes one symbol. So a piece has as many tokens
as it has bytes, less its merges.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.llm._shared import MEMO_BYTES, Memo, arrow_map

#: Fixed value: the pattern that cuts texts of this family of vocabularies, with letters L, numbers N and white space S.
PIECES = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: A letter, a number and another sign, to be asked for beside a code point.
_KINDS = {"O": "!", "L": "a", "N": "1"}


def _kinds_of(block: list[str], cut: Callable) -> list[str]:
    """L, N, O or S for each code point: that of the sign with which the cutter leaves it together, else white space."""
    for kind, sign in _KINDS.items():
        if len(cut(sign + "".join(block))) == 1:
            return [kind] * len(block)
    kinds = ["S"] * len(block)
    for kind, sign in _KINDS.items():
        starts = {span[0] for _, span in cut("\n".join(sign + c for c in block))}
        for i in range(len(block)):
            if 3 * i + 1 not in starts:
                kinds[i] = kind
    return kinds


@cache
def classes() -> dict[str, str]:
    """The letters, numbers and white space that the library's own cutter knows, as ranges for a pattern.

    Asked of the library, whose Unicode may be older or newer than that of other packages.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    cut, spans = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str, {"L": [], "N": [], "S": []}
    for start in range(0, 0x110000, 256):
        block = [c for c in range(start, start + 256) if not 0xD800 <= c < 0xE000]
        for c, kind in zip(block, _kinds_of([chr(c) for c in block], cut) if block else [], strict=True):
            if kind != "O":
                own = spans[kind]
                if own and own[-1][1] == c - 1:
                    own[-1][1] = c
                else:
                    own.append([c, c])
    return {kind: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in own) for kind, own in spans.items()}


@cache
def pieces_of() -> Callable[[str], list[str]]:
    """Cuts a text into the pieces that are merged alone."""
    return re.compile(PIECES.format(**classes())).findall


@cache
def _rare_space() -> re.Pattern:
    """White space other than blanks and line feeds, and the mark that cut() puts in."""
    return re.compile(f"(?![ \n])[{classes()['S']}\x01]")


def cut(text: str) -> list[str] | None:
    """Parts of a text that are tokenised alone: words with the blank before them, line feeds.

    None if the text has runs of white space, or rare white space: then pieces can
    reach over such parts. A piece never reaches over the ends of these parts, since
    a single blank goes with what follows and a single line feed is a piece.
    """
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _rare_space().search(text):
        return None
    return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")


def byte_letters() -> dict[str, int]:
    """The vocabulary's letter for each byte: printable ones stand for themselves, the rest follow from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def check_byte_level(spec: dict) -> None:
    """Raises unless the vocabulary is cut by PIECES and merged from bytes, as the operators here do."""
    model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
    plain = {"type": cutter.get("type"), "blank": cutter.get("add_prefix_space", False), "pattern": cutter.get("use_regex", True)}
    if spec.get("normalizer") or plain != {"type": "ByteLevel", "blank": False, "pattern": True}:
        raise ValueError("only vocabularies without a normaliser, cut by the byte-level pattern, can be counted")
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
        raise ValueError("only plain byte-pair models can be counted")
    if any(not t.get("special") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in spec.get("added_tokens", [])):
        raise ValueError("added tokens must be special, and match as they stand")


class MergeCounter:
    """Counts the tokens of texts under the merges of a ``.json`` byte-pair vocabulary."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_byte_level(spec)
        letters = byte_letters()
        symbol = {x: i for i, x in enumerate(spec["model"]["vocab"])}
        self.first = [0] * 256
        for letter, byte in letters.items():
            self.first[byte] = symbol[letter]
        #: The rank of each pair of symbols that can be merged, and by rank what it gives.
        self.ranks, self.joined = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((symbol[left], symbol[right]), rank)
            self.joined.append(symbol[left + right])
        special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.marks = special
        self.pieces = pieces_of()
        # a piece that is cut again is itself, so one memo holds the counts of pieces and of parts
        self.counts = self.parts = _Parts(self)

    def piece(self, text: str) -> int:
        """Tokens of one piece."""
        known = self.counts.get(text) or self.counts.older(text)
        if not known:
            known = self.merge(text.encode("utf-8", "surrogatepass"))
            self.counts.keep(text, known)
        return known

    def merge(self, data: bytes) -> int:
        n = len(data)
        if n < 2:
            return n
        get, joined = self.ranks.get, self.joined
        symbols = list(map(self.first.__getitem__, data))
        rank_at = list(map(get, zip(symbols, symbols[1:], strict=False)))  # of the pair that starts there, None without a merge
        shift = n.bit_length()
        mask = (1 << shift) - 1
        heap = [rank << shift | i for i, rank in enumerate(rank_at) if rank is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n))
        left_over = n
        while heap:
            lowest = pop(heap)
            i, rank = lowest & mask, lowest >> shift
            if rank_at[i] != rank:
                continue  # one of the two has since been merged
            j = after[i]
            new = symbols[i] = joined[rank]
            rank_at[j if j < n - 1 else i] = None
            left_over -= 1
            k = after[i] = after[j]
            before[k] = i
            rank_at[i] = found = get((new, symbols[k])) if k < n else None
            if found is not None:
                push(heap, found << shift | i)
            h = before[i]
            if h >= 0:
                rank_at[h] = found = get((symbols[h], new))
                if found is not None:
                    push(heap, found << shift | h)
        return left_over

    def plain(self, text: str) -> int:
        """Tokens of a text in which special strings mean nothing."""
        if (parts := cut(text)) is not None:
            return sum(map(self.parts.__getitem__, parts))
        return sum(map(self.piece, self.pieces(text)))

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; each special string in it is one token, as by the library's default."""
        if not text:
            return 0
        if self.special and any(m in text for m in self.marks):
            return sum(map(self.plain, self.special.split(text))) + len(self.special.findall(text))
        return self.plain(text)


class _Parts(Memo):
    """Counts of the parts that cut() gives."""

    def __init__(self, counter: MergeCounter) -> None:
        super().__init__(2 * MEMO_BYTES)
        self.counter = counter

    def __missing__(self, part: str) -> int:
        if (known := self.older(part)) is not None:
            return known
        counter, body = self.counter, part.removeprefix(" ")
        if body.isascii() and body.isalpha():  # one piece
            n = counter.merge(part.encode())
        else:
            pieces = counter.pieces(part)
            n = counter.merge(part.encode("utf-8", "surrogatepass")) if len(pieces) == 1 else sum(map(counter.piece, pieces))
        self.keep(part, n)
        return n


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """The worker's counter for a vocabulary: made once a worker, kept between tasks."""
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    Narrow: no shuffle, and each task holds one Arrow batch of bounded bytes and a memo of
    2 * MEMO_BYTES. A vocabulary of another kind than byte-level pairs raises ValueError.
    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids are
    rows like others. Further columns of ``docs`` are not read. A very long text
    takes O(n log n) for its longest piece.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(map(count, batch.column(2).to_pylist()), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_col).alias("text"),
    )
    out = arrow_map(rows, counted, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
