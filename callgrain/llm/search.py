"""Ranked lexical search over an index of shards.

A task cuts its documents into shards of SHARD bytes of text. A shard has its documents in order of
doc_id and, for each term, a row of compressed postings: varints of the gaps between documents and of
the occurrences. The index is a table like others; a search reads the rows of its terms alone.

In a shard, an item is answered document by document: a heap merges the cursors of its terms'
postings, k ways, and a bounded heap keyed by score, then doc_id, holds the best so far. Terms that
together cannot lift a document into that heap any more leave the merge and are looked up only for
documents that the others bring; this changes no result. The heaps go on from shard to shard of a task, so
tasks hand on k rows an item, and these meet in the global merge.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callgrain.llm._shared import arrow_map, partitions, text_bytes, written

#: Bytes of text in a shard; a longer document is a shard of its own.
SHARD = 16 << 20
#: Pairs of item and term that are searched for together, as expected; up to as many terms are broadcast.
PAIRS, TERMS = 1 << 16, 1 << 18
#: Stands for a null id, after all others.
LAST = 1 << 63
#: Every byte that belongs to no term is a blank, A-Z are lower case; a term is then a run without blanks.
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

INDEX = "shard long, term string, documents long, tokens long, ids binary, data binary"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the low ones first; the top bit says that more follow. The bytes, and where each value begins."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        more = values >> np.uint64(bits) > 0
        if not more.any():
            break
        size += more
    starts = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > k)
        out[starts[own] + k] = (values[own] >> np.uint64(7 * k) & np.uint64(127)) | np.where(size[own] > k + 1, np.uint64(128), np.uint64(0))
    return out, starts


def values_of(data: np.ndarray) -> np.ndarray:
    """The values that varints() wrote."""
    last = np.flatnonzero(data < 128)
    first = np.r_[0, last[:-1] + 1][: len(last)]
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & np.uint8(127)).astype(np.uint64) << (7 * place).astype(np.uint64), first) if len(last) else np.zeros(0, np.uint64)


def postings(data: bytes, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (places in the shard, ascending) and occurrences of one term.

    First come the gaps, doubled, and odd where a document has the term more than once; then the numbers of these.
    """
    values = values_of(np.frombuffer(data, np.uint8)).astype(np.int64)
    gaps, times = values[:documents], np.ones(documents, np.int64)
    times[(gaps & 1).astype(bool)] = values[documents:]
    return np.cumsum(gaps >> 1) - 1, times


class _Shard:
    """Documents gathered for one shard."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.codes: list[np.ndarray] = []
        self.size = 0
        self.code: defaultdict[bytes, int] = defaultdict()
        self.code.default_factory = self.code.__len__

    def add(self, doc_id: int | None, text: bytes) -> None:
        terms = terms_of(text)
        if terms:
            self.ids.append(doc_id)
            self.codes.append(np.fromiter(map(self.code.__getitem__, terms), np.int64, len(terms)))
        self.size += len(text)

    def rows(self, shard: int) -> pa.RecordBatch:
        count, n = len(self.ids), np.array([len(c) for c in self.codes], np.int64)
        known = np.array([i is not None for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], np.int64)
        order = np.lexsort((ids, ~known))
        place = np.empty(count, np.int64)
        place[order] = np.arange(count)
        pairs, times = np.unique(np.concatenate(self.codes) * count + np.repeat(place, n), return_counts=True)
        code, doc = np.divmod(pairs, count)
        first = np.r_[True, code[1:] != code[:-1]]
        gap, many = doc - np.where(first, -1, np.r_[-1, doc[:-1]]), np.flatnonzero(times > 1)
        documents, numbers = np.bincount(code), np.bincount(code[many], minlength=len(self.code))
        ends = np.cumsum(documents + numbers)
        at = ends - documents - numbers
        values = np.zeros(int(ends[-1]), np.uint64)
        values[at[code] + np.arange(len(code)) - np.flatnonzero(first)[code]] = gap * 2 + (times > 1)
        own = code[many]
        values[at[own] + documents[own] + np.arange(len(many)) - (np.cumsum(numbers) - numbers)[own]] = times[many]
        data, starts = varints(values)
        offsets = np.r_[starts[at], len(data)].astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        # the row of the shard's documents has no term: how many have an id, the ids, and the terms in each
        ids, lengths = ids[order], n[order]
        rest = [[shard] * len(packed), list(self.code), documents.tolist(), [None] * len(packed), [None] * len(packed)]
        head = [shard, None, count, int(n.sum()), np.r_[known.sum(), ids].tobytes()]
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
        columns = [pa.array([h, *x], k) for h, x, k in zip(head, rest, kinds, strict=True)]
        columns[1] = columns[1].cast(pa.string())
        columns.append(pa.concat_arrays([pa.array([lengths.tobytes()], pa.binary()), packed]))
        return pa.RecordBatch.from_arrays(columns, ["shard", "term", "documents", "tokens", "ids", "data"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, number = _Shard(), TaskContext.get().partitionId() << 32
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
            if shard.ids and shard.size + len(text) > SHARD:
                yield shard.rows(number)
                shard, number = _Shard(), number + 1
            shard.add(doc_id, text)
    if shard.ids:
        yield shard.rows(number)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """An index of ``docs``: for each shard a row for each term (shard, term, documents, data) and one without a term for its documents.

    Narrow: documents stay in their tasks, and a task holds one shard. Documents without terms are in no shard.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return arrow_map(rows, _shards, INDEX)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items, terms, times = [], [], []
        for item, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
            for term, n in Counter(terms_of(text)).items():
                items.append(item)
                terms.append(term)
                times.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], ["item", "term", "times"])


def merged(lists: list[tuple[int, int, list[int], list[int]]], ids: list[int], k: int, best: list[tuple[int, int]]) -> None:
    """Document-at-a-time: puts a shard's best documents into ``best``, a heap of k (score, -doc_id) at most.

    lists: (bound, times, documents, gains) of each term; bound is times * the largest gain.
    """
    lists.sort(key=lambda x: x[0])
    bounds = list(accumulate(x[0] for x in lists))
    times, docs, gains = ([x[i] for x in lists] for i in (1, 2, 3))
    ways, place = len(lists), [0] * len(lists)
    floor = best[0][0] if len(best) == k else 0
    least = 0  # lists below this one can't bring a document alone
    while least < ways and bounds[least] < floor:
        least += 1
    cursors = [docs[t][0] * ways + t for t in range(least, ways)]
    heapq.heapify(cursors)
    replace, pop = heapq.heapreplace, heapq.heappop
    while cursors:
        doc = cursors[0] // ways
        start, score = doc * ways, 0
        while cursors and (t := cursors[0] - start) < ways:
            at = place[t]
            score += times[t] * gains[t][at]
            place[t] = at = at + 1
            if at < len(docs[t]):
                replace(cursors, docs[t][at] * ways + t)
            else:
                pop(cursors)
        for t in range(least - 1, -1, -1):
            if score + bounds[t] < floor:
                score = 0
                break
            own = docs[t]
            place[t] = at = bisect_left(own, doc, place[t])
            if at < len(own) and own[at] == doc:
                score += times[t] * gains[t][at]
        if score <= 0 or score < floor:
            continue
        if len(best) < k:
            heapq.heappush(best, (score, -ids[doc]))
        else:
            heapq.heappushpop(best, (score, -ids[doc]))
        if len(best) == k and best[0][0] > floor:
            floor, was = best[0][0], least
            while least < ways and bounds[least] < floor:
                least += 1
            if least > was:
                cursors = [c for c in cursors if c % ways >= least]
                heapq.heapify(cursors)


def _search(asked, n_docs: int, n_terms: int, k: int):
    """Rows of the index, sorted by shard, to (item, doc_id, score): the best k of the task for each item."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = asked.value
        best: dict[int, list[tuple[int, int]]] = {item: [] for item in items}
        for head, rows in _by_shard(batches):
            numbers = np.frombuffer(head[0], np.int64)
            known, ids = int(numbers[0]), numbers[1:].tolist()
            ids[known:] = [LAST] * (len(ids) - known)
            m = 100 - 75 + 75 * np.frombuffer(head[1], np.int64) * n_docs // n_terms
            found = {}
            for term, documents, data in rows:
                docs, times = postings(data, documents)
                gain = weights[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m[docs]))
                found[term] = docs.tolist(), gain.tolist(), int(gain.max())
            for item, terms in items.items():
                lists = [(n * found[t][2], n, found[t][0], found[t][1]) for t, n in terms if t in found]
                if lists:
                    merged(lists, ids, k, best[item])
        rows = [(item, None if -doc == LAST else -doc, score) for item, own in best.items() for score, doc in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["item", "doc_id", "score"])

    return search


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[bytes, bytes], list[tuple[str, int, bytes]]]]:
    """The documents of each shard, and the postings in it. Rows come sorted by shard, the documents first."""
    shard, head, rows = None, None, []
    for batch in batches:
        for own, term, documents, ids, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if own != shard:
                if rows:
                    yield head, rows
                shard, head, rows = own, (ids, data), []
            else:
                rows.append((term, documents, data))
    if rows:
        yield head, rows


def search(indexed: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``items``, its k best documents in the index.

    A term's weight w is floor(1000 * ln((2N + 2) / (2 df + 1))) for N documents with terms, df of them with
    this one; a document's score sums w * ((10**9 tf) div (1000 tf + 8 m)) over the item's terms, repeats
    included, where m is 25 + (75 n N) div L for a document of n terms of all L. Only scores above 0 count.
    Equal scores go by ascending doc_id, a null one last. Null texts, and texts without a term, find nothing
    and are found by nothing. Repeated documents, and repeated items, are each ranked for themselves.

    ``indexed`` should be a table (see index()), since it is read several times. Rows of the items' terms
    alone leave the index. Items are searched for in blocks of PAIRS expected pairs of item and term, which
    are broadcast: their number grows with the items, not with the documents. A task holds the postings
    of one shard, and k documents an item.
    """
    spark = indexed.sparkSession
    named = written(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.col(text_col).cast("binary").alias("text")))
    asked = written(arrow_map(named.select("item", "text"), _item_terms, "item long, term string, times long"))
    terms = asked.select("term").distinct()
    few = terms.count() <= TERMS
    heads = indexed.filter("term is null")
    rows = indexed.filter("term is not null").join(F.broadcast(terms) if few else terms.hint("merge"), "term", "left_semi")
    rows = written(rows.select("shard", "term", "documents", "data"))
    n_docs, n_terms = heads.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    used = rows.groupBy("term").agg(F.sum("documents").alias("df"))
    pairs = written(asked.join(used, "term"))
    blocks = max(1, -(-pairs.count() // PAIRS))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    out = []
    for block in range(blocks):
        own, weights = defaultdict(list), {}
        for r in pairs.filter(F.col("block") == block).select("item", "term", "times", "df").collect():  # PAIRS of them, as expected
            weights[r.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
            if weights[r.term] > 0:
                own[r.item].append((r.term, r.times))
        sent = spark.sparkContext.broadcast((dict(own), weights))
        mine = pairs.filter(F.col("block") == block).select("term").distinct()
        own_rows = rows if blocks == 1 else rows.join(F.broadcast(mine), "term", "left_semi")
        met = heads.select("shard", "term", "documents", "ids", "data").unionByName(own_rows.withColumn("ids", F.lit(None).cast("binary")))
        met = met.repartition(partitions(spark), "shard").sortWithinPartitions("shard", F.asc_nulls_first("term"))
        out.append(written(arrow_map(met, _search(sent, n_docs, n_terms, k), "item long, doc_id long, score long")))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """search() over an index of ``docs`` that is made for it."""
    return search(written(index(docs)), items, k)
