"""Fill-in-the-middle transformation, its cuts found by a parallel automaton scan.

One automaton over UTF-8 bytes tells where tokens (runs of A-Z and a-z, and every other
code point) begin and whether a mark occurs. A chunk of text does not know the state it is
entered in, so it emits a function: for every entry state, the state it is left in and the
tokens that began. Such functions compose associatively. Composed over the chunks of a text
they give every chunk's entry state and the tokens before it, and with these the chunk in
which a cut lies; only that chunk is stepped through again to find the place.

The same is done at two levels: blocks of BLOCK bytes within a task, for all texts of a batch at
once, and, for giant documents, pieces of PIECE bytes that are dealt out over tasks. A giant's
functions alone meet in one group; its text is never scanned as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain.llm._shared import arrow_map, attach_groups, chunks, partitions, small_batches, text_bytes, written

#: Marks before the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a block within a task; bytes of a piece that tasks share; a longer text is a giant.
BLOCK, PIECE = 256, 1 << 16

#: States: after another sign, a letter, "<", "<" and the letter of a mark; and the first two again once a mark has occurred.
STATES, OTHER, LETTER, OPEN, MARK, SEEN, SEEN_LETTER = 6, 0, 1, 2, 3, 4, 5
#: Kinds of bytes; a continuation byte belongs to the code point before it, padding changes nothing.
_LETTER, _MARK_LETTER, _OPEN, _CLOSE, _OTHER, _CONTINUED, _PADDING = range(7)


def _automaton() -> tuple[np.ndarray, np.ndarray, bytes]:
    """By kind * 8 + state: the next state, and 1 where a token begins; and kind * 8 for each byte."""
    then, begins = np.zeros(64, np.uint8), np.zeros(64, np.uint8)
    for state in range(STATES):
        seen = state >= SEEN
        for kind in (_LETTER, _MARK_LETTER):
            then[kind * 8 + state] = SEEN_LETTER if seen else MARK if (kind, state) == (_MARK_LETTER, OPEN) else LETTER
            begins[kind * 8 + state] = state not in (LETTER, MARK, SEEN_LETTER)
        for kind in (_OPEN, _CLOSE, _OTHER, _CONTINUED):
            found = seen or (kind, state) == (_CLOSE, MARK)
            then[kind * 8 + state] = SEEN if found else OPEN if kind == _OPEN else OTHER
            begins[kind * 8 + state] = kind != _CONTINUED
        then[_PADDING * 8 + state] = state
    kinds = np.full(256, _OTHER, np.uint8)
    kinds[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = _LETTER
    kinds[[ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]] = _MARK_LETTER
    kinds[ord("<")], kinds[ord(">")], kinds[0x80:0xC0] = _OPEN, _CLOSE, _CONTINUED
    return then, begins, (kinds * 8).tobytes()


NEXT, BEGINS, KIND = _automaton()
_PAD = bytes([_PADDING * 8])


def composed(exits: np.ndarray, counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of functions (STATES, n), each composed with all before it from ``first[i]`` on, in log2 steps.

    exits[s, i] is the state in which chunk i is left when entered in s, counts[s, i] the tokens that begin in it then.
    """
    at, step = np.arange(len(first)), 1
    reach = int((at - first).max(initial=0))
    while step <= reach:
        own = np.flatnonzero(at - step >= first)
        before, own_exits, own_counts = exits[:, own - step], exits[:, own], counts[:, own]
        sums = counts[:, own - step] + np.take_along_axis(own_counts, before.astype(np.int64), 0)
        exits, counts = exits.copy(), counts.copy()
        exits[:, own], counts[:, own] = np.take_along_axis(own_exits, before.astype(np.int64), 0), sums
        step *= 2
    return exits, counts


class Scan:
    """Some texts (or pieces of texts), in blocks, and the blocks' composed functions."""

    def __init__(self, texts: list[bytes]) -> None:
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.blocks = -(-self.sizes // BLOCK)
        self.ends = np.cumsum(self.blocks)
        self.starts = self.ends - self.blocks
        padded = b"".join(t.translate(KIND).ljust(int(n) * BLOCK, _PAD) for t, n in zip(texts, self.blocks, strict=True))
        self.kinds = np.frombuffer(padded, np.uint8).reshape(-1, BLOCK)
        lead = (self.kinds != _CONTINUED * 8) & (self.kinds != _PADDING * 8)
        self.chars = np.r_[0, np.cumsum(lead.sum(1, dtype=np.int64))]
        n = len(self.kinds)
        exits = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], n, 1)
        counts = np.zeros((STATES, n), np.uint16)  # a block has BLOCK at most
        for kind in np.ascontiguousarray(self.kinds.T):
            at = exits + kind
            counts += BEGINS[at]
            exits = NEXT[at]
        self.first = np.repeat(self.starts, self.blocks)
        self.exits, self.counts = composed(exits, counts.astype(np.int64), self.first)

    def functions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: exit states and counts (texts, STATES), code points that begin in it."""
        last = np.maximum(self.ends - 1, 0)
        exits = np.repeat(np.arange(STATES, dtype=np.uint8)[None], len(self.sizes), 0)
        counts, full = np.zeros((len(self.sizes), STATES), np.int64), self.blocks > 0
        if full.any():
            exits[full], counts[full] = self.exits[:, last[full]].T, self.counts[:, last[full]].T
        return exits, counts, self.chars[self.ends] - self.chars[self.starts]

    def places(self, text: np.ndarray, entry: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte and code point at which each asked token (from 0) of a text entered in ``entry`` begins; the text's end if it has no such token."""
        _, counts, chars = self.functions()
        offset, before = self.sizes[text].copy(), chars[text].copy()
        inside = np.flatnonzero(token < counts[text, entry])
        if not len(inside):
            return offset, before
        text, entry, token = text[inside], entry[inside], token[inside]
        low, high = self.starts[text], self.ends[text] - 1
        while (low < high).any():  # the last block before which at most ``token`` tokens have begun
            mid = (low + high + 1) // 2
            under = np.where(mid > self.starts[text], self.counts[entry, mid - 1], 0) <= token
            low, high = np.where(under, mid, low), np.where(under, high, mid - 1)
        inner = low > self.starts[text]
        state = np.where(inner, self.exits[entry, low - 1], entry).astype(np.uint8)
        left = token - np.where(inner, self.counts[entry, low - 1], 0)
        kinds, begun = self.kinds[low], np.zeros((len(low), BLOCK), np.uint8)
        for i in range(BLOCK):
            at = kinds[:, i] + state
            begun[:, i], state = BEGINS[at], NEXT[at]
        place = (np.cumsum(begun, 1) > left[:, None]).argmax(1)
        lead = (kinds != _CONTINUED * 8) & (np.arange(BLOCK) < place[:, None])
        offset[inside] = (low - self.starts[text]) * BLOCK + place
        before[inside] = self.chars[low] - self.chars[self.starts[text]] + lead.sum(1)
        return offset, before


def _cuts(n: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = h1 % (n + 1), h2 % (n + 1)
    return np.minimum(a, b), np.maximum(a, b)


_FOUND = "n long, marked boolean, a long, b long, prefix_chars long, middle_chars long"


def _whole_texts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """Tokens and cuts of texts that a task takes whole."""
    texts, h1, h2 = text_bytes(text), h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False)
    parts = [[np.zeros(0, t)] for t in (np.int64, bool, np.int64, np.int64, np.int64, np.int64)]
    for s, e in chunks(texts):
        scan = Scan(texts[s:e])
        exits, counts, _ = scan.functions()
        n, own = counts[:, OTHER], np.arange(e - s)
        low, high = _cuts(n, h1[s:e], h2[s:e])
        entry = np.full(2 * (e - s), OTHER)
        place, before = scan.places(np.r_[own, own], entry, np.r_[low, high])
        (a, b), (c, d) = np.split(place, 2), np.split(before, 2)
        for part, x in zip(parts, (n, exits[:, OTHER] >= SEEN, a, b, c, d - c), strict=True):
            part.append(x)
    return pa.StructArray.from_arrays([pa.array(np.concatenate(p)) for p in parts], [x.split(" ")[0] for x in _FOUND.split(", ")])


def _places_in(text: pa.Array, entry: pa.Array, token: pa.Array) -> pa.Array:
    """Byte and code point of a token within a piece; the piece's end if it has no such token."""
    scan, (entry, token) = Scan(text_bytes(text)), (x.to_numpy(zero_copy_only=False) for x in (entry, token))
    place, before = scan.places(np.arange(len(entry)), entry, token)
    return pa.StructArray.from_arrays([pa.array(place), pa.array(before)], ["byte", "char"])


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, piece, h1, h2, text) to the piece's function."""
    for batch in batches:
        texts = text_bytes(batch.column(4))
        for s, e in chunks(texts):
            exits, counts, chars = Scan(texts[s:e]).functions()
            made = [pa.array(list(exits.astype(np.int16)), pa.list_(pa.int16())), pa.array(list(counts), pa.list_(pa.int64())), pa.array(chars)]
            yield pa.RecordBatch.from_arrays([c.slice(s, e - s) for c in batch.columns[:4]] + made, ["key", "piece", "h1", "h2", "exits", "counts", "chars"])


def _resolved(table: pa.Table) -> pa.Table:
    """A giant's functions, one row a piece, to its tokens and the pieces, entry states and tokens of its two cuts."""
    table = table.sort_by("piece")
    _, once = np.unique(table.column("piece").to_numpy(), return_index=True)  # equal rows have equal pieces
    copies = len(table) // len(once)
    exits = np.array(table.column("exits").to_pylist(), np.uint8)[once].T
    counts = np.array(table.column("counts").to_pylist(), np.int64)[once].T
    chars = np.r_[0, np.cumsum(table.column("chars").to_numpy()[once])]
    left, sums = composed(exits, counts, np.zeros(len(once), np.int64))
    n = sums[OTHER, -1:]
    out: dict = {"key": table.column("key")[:1].combine_chunks(), "copies": [copies], "n": n, "marked": left[OTHER, -1:] >= SEEN}
    before, entry = np.r_[0, sums[OTHER, :-1]], np.r_[OTHER, left[OTHER, :-1]]
    for name, cut in zip("ab", _cuts(n, table.column("h1").to_numpy()[:1], table.column("h2").to_numpy()[:1]), strict=True):
        at = np.searchsorted(before, cut, "right") - 1  # for the end of the text, its last piece
        out |= {f"{name}_piece": at, f"{name}_entry": entry[at].astype(np.int64), f"{name}_token": cut - before[at], f"{name}_chars": chars[at]}
    return pa.table(out)


_RESOLVED = "key string, copies long, n long, marked boolean, " + ", ".join(f"{x}_{y} long" for x in "ab" for y in ("piece", "entry", "token", "chars"))


def _with_parts(rows: DataFrame, spark) -> DataFrame:
    """(doc_id, body, size, h1 .. h4) with the tokens, and the places of the cuts in bytes and code points."""
    whole = F.arrow_udf(_whole_texts, _FOUND)
    small = rows.filter(F.col("size") <= PIECE).withColumn("found", whole("body", "h1", "h2")).select("doc_id", "body", "h3", "h4", "found.*")

    giants = rows.filter(F.col("size") > PIECE).withColumn("key", F.concat_ws(":", F.sha2("body", 256), F.col("doc_id").cast("string")))
    piece = F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / PIECE).cast("int")))
    pieces = giants.withColumn("piece", piece).select("key", F.col("piece").cast("long").alias("piece"), "h1", "h2", F.substr("body", F.col("piece") * PIECE + 1, F.lit(PIECE)).alias("text"))
    pieces = pieces.withColumn("_from", F.spark_partition_id()).repartition(partitions(spark), "key", "piece", "_from").drop("_from")
    functions = written(arrow_map(pieces, _functions, "key string, piece long, h1 long, h2 long, exits array<smallint>, counts array<long>, chars long"))
    resolved = written(functions.groupBy("key").applyInArrow(_resolved, _RESOLVED))
    place = F.arrow_udf(_places_in, "byte long, char long")
    met = attach_groups(giants, resolved, "key", "copies", giants.count())
    for x in "ab":
        text = F.substr("body", (F.col(f"{x}_piece") * PIECE + 1).cast("int"), F.lit(PIECE))
        met = met.withColumn(f"{x}_at", place(text, F.col(f"{x}_entry"), F.col(f"{x}_token")))
    byte, char = ((lambda x, f=f, s=s: F.col(f"{x}_{s}") * (PIECE if f == "byte" else 1) + F.col(f"{x}_at.{f}")) for f, s in (("byte", "piece"), ("char", "chars")))
    large = met.select("doc_id", "body", "h3", "h4", "n", "marked", byte("a").alias("a"), byte("b").alias("b"), char("a").alias("prefix_chars"), (char("b") - char("a")).alias("middle_chars"))
    return small.unionByName(large)


def _drawn(key: Column, i: int) -> Column:
    """The i-th group of eight hex digits as an unsigned number."""
    return F.conv(F.substr(key, F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("long")


def filled_in_middle(docs: DataFrame, plain_from: int = 90, spm_below: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row of ``docs``.

    n counts the tokens of the whole text. Two cuts, drawn by a hash of the id, split it into prefix,
    middle and suffix; ``form`` is psm (``<P>`` prefix ``<S>`` suffix ``<M>`` middle), spm (``<S>`` suffix
    ``<P>`` prefix ``<M>`` middle), or plain: the text as it is, where it is empty or has a mark in it,
    or is drawn so (of 100, those from ``plain_from`` on). Of the others, ``spm_below`` in 100 are spm.
    Chars count code points and are null if plain. Null texts are empty; a null id is drawn as "".
    Repeated rows and rows with one id are rows like others. Further columns are not read.

    Texts of PIECE bytes at most are scanned where they are, without a shuffle. Of longer ones the
    pieces are dealt out over tasks, and their functions, about 100 bytes a piece, meet by document.
    A row has 2 GB at most, so a document has 32,768 functions at most.
    """
    spark = docs.sparkSession
    small_batches(spark)
    drawn = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), body.alias("body"), drawn.alias("_drawn"))
    rows = rows.select("doc_id", "body", F.octet_length("body").alias("size"), *[_drawn(F.col("_drawn"), i).alias(f"h{i + 1}") for i in range(4)])
    cut = _with_parts(rows, spark)
    plain = (F.octet_length("body") == 0) | F.col("marked") | (F.pmod("h3", F.lit(100)) >= plain_from)
    cut = cut.withColumn("form", F.when(plain, "plain").when(F.pmod("h4", F.lit(100)) < spm_below, "spm").otherwise("psm"))
    a, b, mark = F.col("a").cast("int"), F.col("b").cast("int"), lambda m: F.lit(m).cast("binary")
    prefix, middle, suffix = F.substr("body", F.lit(1), a), F.substr("body", a + 1, b - a), F.substr("body", b + 1, F.octet_length("body"))
    output = (
        F.when(F.col("form") == "psm", F.concat(mark(PREFIX), prefix, mark(SUFFIX), suffix, mark(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(mark(SUFFIX), suffix, mark(PREFIX), prefix, mark(MIDDLE), middle))
        .otherwise(F.col("body"))
    )
    chars = [F.when(F.col("form") != "plain", F.col(c)).alias(c) for c in ("prefix_chars", "middle_chars")]
    return cut.select("doc_id", "n", "form", *chars, output.cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text from which ``output`` was made: its parts lie between marks that occur once."""
    part = F.split(output, "<[PSM]>", -1)
    first, second, middle = part[1], part[2], part[3]
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)
