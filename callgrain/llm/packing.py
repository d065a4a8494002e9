"""Packing tokenised documents into sequences of a fixed length.

Bounded-space online best-fit: a task has a fixed number of open bins. A bitset has
one bit for each amount of free space; the lowest bit at or above a piece's length
is the open bin it fits best. When no bin fits and all are in use, the fullest one
is closed. Tasks pack their own rows, and rows of closed bins are not shuffled; a second round,
over one row a bin, packs the bins that were still open when the tasks ended into one
another, and the rows of these bins alone are joined to it.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.llm._shared import arrow_map, partitions, written
from callgrain.llm.tokens import PIECES, byte_letters, check_byte_level, classes

#: Open bins in the second round's tasks: all that one task gets.
ROUND_BINS = 4096
#: Rows that leave a task together.
ROWS = 8192


class BestFit:
    """Open bins by free space. ``put`` returns (bin, offset); bins that it closed are added to ``closed``."""

    def __init__(self, size: int, bins: int) -> None:
        self.size, self.bins = size, bins
        self.free: list[list[int]] = [[] for _ in range(size + 1)]  # bins by free space
        self.bits, self.open, self.made = 0, 0, 0
        self.closed: list[int] = []

    def put(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            own = self._take(space)
        else:
            if self.open == self.bins:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))  # the fullest
            own, space = self.made, self.size
            self.made += 1
        if left := space - length:
            self.free[left].append(own)
            self.bits |= 1 << left
            self.open += 1
        else:
            self.closed.append(own)
        return own, self.size - space

    def _take(self, space: int) -> int:
        same = self.free[space]
        own = same.pop()
        if not same:
            self.bits ^= 1 << space
        self.open -= 1
        return own

    def still_open(self) -> Iterator[tuple[int, int]]:
        for space, same in enumerate(self.free):
            for own in same:
                yield own, self.size - space


def _by_ranks(spec: dict) -> tiktoken.Encoding | None:
    """The vocabulary as ranks, which are merged much faster; None unless it is cut and merged so.

    Merges are taken by rank there, and ranks are identifiers: those of merges must follow their order. Texts are
    cut by the library's own classes of code points, so both give the same ids.
    """
    try:
        check_byte_level(spec)
    except ValueError:
        return None
    vocabulary, letters = spec["model"]["vocab"], byte_letters()
    made = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in spec["model"]["merges"]]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in special}
    if made != sorted(set(made)) or any(bytes([b]) not in ranks for b in range(256)):
        return None
    pattern = PIECES.format(**{k: re.sub(r"\\U([0-9a-f]{8})", r"\\x{\1}", v) for k, v in classes().items()})
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class _Ids:
    """Little-endian unsigned 32-bit ids of whole texts."""

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranks = _by_ranks(json.loads(self.tokenizer.to_str()))

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def of(self, text: str | None) -> bytes:
        """By ranks, unless the vocabulary is of another kind or the text has a special string in it."""
        if not text:
            return b""
        if self.ranks is None or any(m in text for m in self.marks):
            return self.whole(text)
        return array("I", self.ranks.encode_ordinary(text)).tobytes()


_ids: dict[str, _Ids] = {}


def ids_of(path: str) -> _Ids:
    if path not in _ids:
        _ids[path] = _Ids(path)
    return _ids[path]


def pieces(n: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces; of a longer one, the first piece has what is over."""
    start, length = 0, n % size or min(n, size)
    while start < n:
        yield start, length
        start, length = start + length, size


def packed(
    docs: DataFrame,
    vocabulary: str,
    size: int = 1024,
    end_id: int = 2,
    bins: int = 1024,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids, then ``end_id``; null and empty texts are ``end_id`` alone.
    Only documents of more than ``size`` ids are cut. Repeated rows and null ids are
    packed like others, each row for itself. Further columns are not read. ``with_ids``
    adds the pieces' ids as little-endian unsigned 32-bit numbers.
    A task holds ``bins`` open bins at most, and the rows in them; rows leave it when their bin
    closes, and those pass straight through. Only rows of bins still open at a task's end meet
    the second round's table again, in a join by bin.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    end = array("I", [end_id]).tobytes()

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, best = ids_of(vocabulary), BestFit(size, bins)
        task, held, out = TaskContext.get().partitionId() << 32, {}, []
        doc_kind = pa.int64()

        def leave(own: int, used: int | None) -> None:
            out.extend((*row, task + own, used) for row in held.pop(own))

        for batch in batches:
            doc_kind = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body = ids.of(text) + end
                for piece, (start, length) in enumerate(pieces(len(body) // 4, size)):
                    own, offset = best.put(length)
                    data = body[4 * start : 4 * (start + length)]
                    held.setdefault(own, []).append((doc, piece, start, length, zlib.crc32(data), data if with_ids else None, offset))
                    while best.closed:
                        leave(best.closed.pop(), None)
                if len(out) > ROWS:
                    yield _batch(out, doc_kind)
                    out.clear()
        for own, used in best.still_open():
            leave(own, used)
        yield _batch(out, doc_kind)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary, offset long, bin long, used long"
    rows = written(arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), fit, schema))
    still = rows.filter("used is not null")
    moved = _merged(still.select("bin", "used").distinct(), size)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    closed = rows.filter("used is null").withColumn("sequence_id", F.col("bin"))
    again = still.join(moved, "bin").withColumn("sequence_id", F.col("into")).withColumn("offset", F.col("offset") + F.col("shift"))
    return closed.select(*names).unionByName(again.select(*names))


def _batch(rows: list[tuple], doc_kind: pa.DataType) -> pa.RecordBatch:
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "offset", "bin", "used"]
    kinds = [doc_kind, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)


def _merged(left: DataFrame, size: int) -> DataFrame:
    """(bin, into, shift) for bins that were open at the end: whole bins are packed by best fit.

    Some 4,000 bins meet in a task, dealt by hash; there are ``bins`` times as many
    as tasks at most, so this table is small beside the pieces.
    """
    spark = left.sparkSession
    tasks = max(1, min(partitions(spark), left.count() // 4000))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [(used, own) for b in batches for own, used in zip(*b.to_pydict().values(), strict=True)]
        items.sort(key=lambda x: (-x[0], x[1]))
        best, first, rows = BestFit(size, ROUND_BINS), {}, []
        for used, own in items:
            into, shift = best.put(used)
            rows.append((own, first.setdefault(into, own), shift))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["bin", "into", "shift"])

    return written(left.repartition(tasks, F.xxhash64("bin")).mapInArrow(merge, "bin long, into long, shift long"))
