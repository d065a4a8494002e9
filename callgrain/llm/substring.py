"""Removal of repeated passages by seed and extend.

Seeds are winnowed anchors: in every window of ``window`` words the run of ``SEED`` words
with the least hash. Equal windows choose equal anchors, so the occurrences of a repeated
window meet at its anchor. Only anchors that occur more than once go on: each occurrence is
extended both ways over the windows that chose it, and the extended occurrences of an anchor
are compared, window by window, in the task that holds the anchor. Runs of repeated windows
are the maximal repeats; all words of theirs but the first occurrence's go.

Frequent anchors are spread over tasks: within each, the first occurrence of a window is
found, and only such firsts meet once more, by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgrain.llm._shared import arrow_map, bitmap_bytes, by_bucket, chunks, dealt, filter_bits, gathered, in_bitmap, mixed, partitions, runs, signed, text_bytes, word_hashes, written

#: Words in an anchor.
SEED = 6
#: An anchor with more occurrences is spread over SPREAD tasks.
FREQUENT, SPREAD = 512, 64
#: Buckets of anchors for each task or input partition: what a task holds is one bucket.
BUCKETS = 8
#: Stands for a null id, after all others.
LAST = (1 << 63) - 1


class Chunk:
    """Words of some documents: their hashes, and where each document's begin."""

    def __init__(self, texts: list[bytes], window: int) -> None:
        self.words = [t.split() for t in texts]  # bytes are split at ASCII white space alone
        self.sizes = np.array([len(w) for w in self.words])
        self.starts = np.r_[0, np.cumsum(self.sizes)].astype(np.int64)
        self.hashes = mixed(word_hashes([w for own in self.words for w in own]))
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        n = len(self.hashes)
        self.windows = runs(self.hashes, window)
        whole = self.doc[: max(0, n - window + 1)] == self.doc[window - 1 :] if n >= window else np.zeros(0, bool)
        self.at = np.flatnonzero(whole)  # starts of windows within one document

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """For each window of ``at``, the place of its anchor; and the seeds' hashes by place."""
        seeds = mixed(runs(self.hashes, SEED), 1)
        if not len(self.at):
            return np.zeros(0, np.int64), seeds
        views = sliding_window_view(seeds, window - SEED + 1)[self.at]
        return self.at + views.argmin(1), seeds


def _keys(column: pa.Array) -> np.ndarray:
    return np.array([LAST if x is None else x for x in column.to_pylist()], np.int64)


def _seed_rows(buckets: int, window: int):
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(0))
            for a, b in chunks(texts):
                chunk = Chunk(texts[a:b], window)
                places, hashes = chunk.anchors(window)
                own = hashes[np.unique(places)]
                yield by_bucket((own >> np.uint64(40)).astype(np.int64) % buckets, [own], ["seeds"])

    return seeds


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds that occur more than once, with their counts. A bucket is in one task; rows come sorted by bucket."""
    for (own,) in gathered(batches, (np.uint64,)):
        seeds, n = np.unique(own, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(signed(seeds[n > 1])), pa.array(n[n > 1])], ["seed", "n"])


def _extended(window: int, bits, frequent, buckets: int):
    """Windows around repeated anchors: (bucket, seeds, windows, docs, rows, places), frequent anchors dealt by row."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, common = bits.value, frequent.value
        for batch in batches:
            ids, marks, texts = _keys(batch.column(0)), batch.column(1).to_numpy(), text_bytes(batch.column(2))
            for a, b in chunks(texts):
                chunk = Chunk(texts[a:b], window)
                places, hashes = chunk.anchors(window)
                own = hashes[places] if len(places) else np.zeros(0, np.uint64)
                keep = in_bitmap(filled, own)
                at, own = chunk.at[keep], own[keep]
                doc = chunk.doc[at]
                spread = np.isin(own, common)
                deal = (own >> np.uint64(40)) + np.where(spread, mixed((ids ^ marks)[a:b][doc].view(np.uint64), 3) % np.uint64(SPREAD), 0).astype(np.uint64)
                columns = [own, chunk.windows[at], ids[a:b][doc], marks[a:b][doc], (at - chunk.starts[doc]).astype(np.int32)]
                yield by_bucket(deal.astype(np.int64) % buckets, columns, ["seeds", "windows", "docs", "rows", "places"])

    return extend


def _compared(frequent):
    """(doc, row, places, seed, window): windows met before in a smaller document; or, with a window, the firsts of frequent anchors.

    The places of a document's firsts of one window are one row, however often it repeats the window.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = frequent.value
        for seeds, windows, docs, rows, places in gathered(batches, (np.uint64, np.uint64, np.int64, np.int64, np.int32)):
            order = np.lexsort((docs, seeds, windows))
            seeds, windows, docs, rows, places = seeds[order], windows[order], docs[order], rows[order], places[order]
            new = np.r_[True, (windows[1:] != windows[:-1]) | (seeds[1:] != seeds[:-1])][: len(seeds)]
            first = docs[np.flatnonzero(new)][np.cumsum(new) - 1] if len(seeds) else docs
            later = docs > first
            none = np.zeros(int(later.sum()), np.uint64)
            yield _ranges(docs[later], rows[later], places[later], none, none, False)
            if len(common) and (firsts := ~later & np.isin(seeds, common)).any():
                yield _ranges(docs[firsts], rows[firsts], places[firsts], seeds[firsts], windows[firsts], True)

    return compare


def _ranges(docs: np.ndarray, rows: np.ndarray, places: np.ndarray, seeds: np.ndarray, windows: np.ndarray, named: bool) -> pa.RecordBatch:
    """A line for each row of a document, and window if ``named``; its window starts as bytes."""
    order = np.lexsort((places, windows, seeds, rows, docs))
    docs, rows, places, seeds, windows = docs[order], rows[order], places[order], seeds[order], windows[order]
    change = (docs[1:] != docs[:-1]) | (rows[1:] != rows[:-1]) | (seeds[1:] != seeds[:-1]) | (windows[1:] != windows[:-1])
    starts = np.flatnonzero(np.r_[True, change][: len(docs)])
    ends = np.r_[starts[1:], len(docs)][: len(starts)]
    blobs = [places[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
    marks = [pa.array(signed(x[starts])) if named else pa.nulls(len(starts), pa.int64()) for x in (seeds, windows)]
    return pa.RecordBatch.from_arrays([pa.array(docs[starts]), pa.array(rows[starts]), pa.array(blobs, pa.binary()), *marks], ["doc", "row", "places", "seed", "window"])


def _cleaned(window: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = text_bytes(batch.column(1)), batch.column(2).to_pylist()
            out: list[tuple[int, int, str, bytes]] = []
            for a, b in chunks(texts):
                chunk = Chunk(texts[a:b], window)
                gone = np.zeros(len(chunk.windows), bool)
                # repeats within a document: the later of two windows
                order = np.lexsort((chunk.at, chunk.windows[chunk.at], chunk.doc[chunk.at])) if len(chunk.at) else chunk.at
                s = chunk.at[order]
                again = (chunk.windows[s][1:] == chunk.windows[s][:-1]) & (chunk.doc[s][1:] == chunk.doc[s][:-1])
                if again.any():
                    second = runs(mixed(chunk.hashes, 8), window)
                    again &= second[s[1:]] == second[s[:-1]]
                gone[s[1:][again]] = True
                for i in range(a, b):
                    for blob in found[i] or ():
                        gone[np.frombuffer(blob, np.int32) + chunk.starts[i - a]] = True
                at = np.flatnonzero(gone)
                change = np.zeros(len(chunk.hashes) + 1, np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
                removed = np.cumsum(change)[:-1] > 0
                for i in range(b - a):
                    words, mask = chunk.words[i], removed[chunk.starts[i] : chunk.starts[i + 1]]
                    n = int(mask.sum())
                    kept = b" ".join(words if not n else [w for w, m in zip(words, mask.tolist(), strict=True) if not m])
                    out.append((len(words), n, hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return clean


def _binary(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def without_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row; ``with_text`` adds the words that stay.

    A word goes if a window of ``window`` words over it also starts earlier: in a smaller
    doc_id, or before it in the same row. A null id comes after all others; rows with the same
    id count as one place, so neither is earlier than the other (repeated rows stay alike).
    Rows are told apart by id and a 64-bit hash of the text, so what is found in one is
    taken from rows alike only. Null, empty and short texts keep all words. doc_id must be a whole number; further
    columns are not read.

    Windows are compared by 128 bits of hashes. Tasks hold one bucket of anchors at a
    time; buckets grow in number with the text. The filter of repeated anchors and the
    list of frequent ones that tasks get are 16 MB at most and 8 bytes for each FREQUENT
    occurrences, 1,000,000 at most; a full filter only lets more anchors through.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _binary(F.col(text_col)).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("row"), "text")
    buckets = max(partitions(spark), rows.rdd.getNumPartitions()) * BUCKETS
    seeds = arrow_map(rows.select("text"), _seed_rows(buckets, window), "bucket int, seeds binary")
    repeated = written(dealt(seeds, "bucket").mapInArrow(_repeated, "seed long, n long"))
    bits = filter_bits(repeated.count())
    filled = sc.broadcast(bitmap_bytes(repeated.select(F.pmod("seed", F.lit(bits)).alias("slot")), bits))
    most = repeated.filter(F.col("n") > FREQUENT).orderBy(F.desc("n"), "seed").limit(1_000_000).select("seed").collect()
    frequent = sc.broadcast(np.array([r.seed for r in most], np.int64).view(np.uint64))
    around = arrow_map(rows, _extended(window, filled, frequent, buckets), "bucket int, seeds binary, windows binary, docs binary, rows binary, places binary")
    met = written(dealt(around, "bucket").mapInArrow(_compared(frequent), "doc long, row long, places binary, seed long, window long"))
    # a window of a frequent anchor has a row for each document that is first in one of SPREAD tasks
    own = Window.partitionBy("seed", "window")
    late = met.filter("seed is not null").withColumn("least", F.min("doc").over(own)).filter("doc > least")
    found = met.filter("seed is null").select("doc", "row", "places").unionByName(late.select("doc", "row", "places"))
    per_row = found.groupBy("doc", "row").agg(F.collect_list("places").alias("found"))
    joined = rows.withColumn("doc", F.coalesce("doc_id", F.lit(LAST))).join(per_row.hint("merge"), ["doc", "row"], "left").select("doc_id", "text", "found")
    out = arrow_map(joined, _cleaned(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string")) if with_text else out.drop("kept")
