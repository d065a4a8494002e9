"""Near duplicates by MinHash, candidates verified by a sequential Bayesian test.

A document is its set of distinct word shingles. A signature has BANDS * ROWS least hashes; sets that
agree in all rows of a band are candidates. Two signatures are compared batch by batch: after each, the
agreements so far give a posterior of the similarity (a Beta distribution, from a flat prior), and a pair goes
once its chance of reaching the threshold is below ``miss``. Those that pass all batches are verified
on the full sets, so every link is a true one.

Equal sets are one class from the start. Of the classes that meet in a band, not all pairs are made: each is
compared with the band's first class, and only classes that are in different components after that are
compared with one another, within tasks that share such a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.llm._shared import arrow_map, attach_groups, mixed, signed, text_bytes, written
from callgrain.llm.jaccard import _compared, _ends, _may_link, _pairs_across, _parity_bits, _sets_of, _where, _with_components, class_of, shingle_sets, sketch
from callgrain.llm.graph import components

#: Bands of a signature and least hashes in each. At a similarity of 0.85, a pair meets in no band once in 10 million times.
BANDS, ROWS = 28, 5
#: Agreements are judged after each so many hashes.
BATCH = 28
#: Shingles hashed at once, so that they stay in a core's cache; classes that a task remembers.
AT_ONCE, REMEMBERED = 1 << 15, 1 << 16

_SEEDS = np.random.default_rng(13).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
#: A signature's length in 64-bit words; parity bits follow it.
_WORDS = BANDS * ROWS // 2


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of least hashes (uint32) for each set of 64-bit shingle hashes; sets must not be empty."""
    out = np.zeros((len(sets), len(_SEEDS)), np.uint32)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= AT_ONCE):
            size += len(sets[end])
            end += 1
        x = (np.concatenate(sets[at:end]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[at : end - 1])])
        h, t = np.empty_like(x), np.empty_like(x)
        for k, seed in enumerate(_SEEDS):
            np.bitwise_xor(x, seed, out=h)
            np.multiply(h, np.uint32(0x85EBCA6B), out=h)
            np.right_shift(h, np.uint32(15), out=t)
            np.bitwise_xor(h, t, out=h)
            np.multiply(h, np.uint32(0xC2B2AE35), out=h)
            np.right_shift(h, np.uint32(13), out=t)
            np.bitwise_xor(h, t, out=h)
            out[at:end, k] = np.minimum.reduceat(h, starts)
        at = end
    return out


def least_agreements(compared: int, threshold: int, miss: float) -> int:
    """Of ``compared`` hashes, the fewest agreements with which a similarity of threshold % or more has a chance of ``miss``.

    With a flat prior, m agreements leave a Beta(m + 1, compared - m + 1); it lies above t with the
    chance that compared + 1 draws of t succeed at most m times.
    """
    t, n, chance = threshold / 100, compared + 1, 0.0
    for m in range(compared + 1):
        chance += math.comb(n, m) * t**m * (1 - t) ** (n - m)
        if chance >= miss:
            return m
    return compared


def agreeing(one: np.ndarray, others: np.ndarray, least: list[int]) -> np.ndarray:
    """Places of the signatures ``others`` that are not pruned after any batch against ``one``; least[i]: the agreements needed after batch i."""
    alive, agreed = np.arange(len(others)), np.zeros(len(others), np.int64)
    for i, need in enumerate(least):
        part = slice(i * BATCH, (i + 1) * BATCH)
        agreed = agreed + (others[alive, part] == one[part]).sum(1)
        keep = agreed >= need
        alive, agreed = alive[keep], agreed[keep]
        if not len(alive):
            break
    return alive


def _bounds(threshold: int, miss: float) -> list[int]:
    n = len(_SEEDS)
    return [least_agreements(min(n, k + BATCH), threshold, miss) for k in range(0, n, BATCH)]


def _summaries(words: int):
    """(doc_id, n, class, sketch) for each row; the sketch, signature and parity bits, once for each class that a task remembers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            n, own, new, at = [], [], [], []
            for i, s in enumerate(shingle_sets(text_bytes(batch.column(1)), words)):
                n.append(len(s))
                own.append(class_of(s))
                if len(s) and int(own[-1]) not in seen:
                    if len(seen) == REMEMBERED:
                        seen.clear()
                    seen.add(int(own[-1]))
                    new.append(s)
                    at.append(i)
            signs: list[bytes | None] = [None] * len(n)
            for i, s, row in zip(at, new, signatures(new), strict=True):
                signs[i] = row.tobytes() + sketch(s).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(signed(np.array(own, np.uint64))), pa.array(signs, pa.binary())], ["doc_id", "n", "class", "sketch"])

    return sums


def band_keys(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band of each signature."""
    parts = rows.reshape(len(rows), BANDS, ROWS).astype(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)[None]
    for i in range(ROWS):
        keys = mixed(keys ^ parts[:, :, i], 41 + i)
    return signed(keys)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, sketch) to (band, class), a row for each band."""
    for batch in batches:
        keys = band_keys(_signatures_of(batch.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["band", "class"])


def _signatures_of(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x[: 8 * _WORDS] for x in blobs), np.uint32).reshape(len(blobs), len(_SEEDS))


def _by_signature(threshold: int, miss: float):
    least = _bounds(threshold, miss)

    def holds(x: tuple, y: tuple) -> bool:
        return len(agreeing(x[0], y[0][None], least)) > 0 and bool(_may_link(*x[1:], *y[1:], threshold))

    return lambda batches: _compared(batches, threshold, holds, lambda n, blob: (blob[:_WORDS].view(np.uint32), blob[_WORDS:], n))


def _by_set(threshold: int):
    def holds(s: np.ndarray, t: np.ndarray) -> bool:
        shared = len(np.intersect1d(s, t, assume_unique=True))
        return 100 * shared >= threshold * (len(s) + len(t) - shared)

    return lambda batches: _compared(batches, threshold, holds, lambda n, tokens: tokens)


def _matcher(miss: float):
    """Members of a cell whose signatures are not pruned against one's, and whose parity bits allow a link.

    Two that meet in several bands are a pair in the least of these alone. Of bands with the same classes, the least
    is looked at, so the least band of a pair is always among those.
    """

    def of(blobs: list[bytes], n: np.ndarray, threshold: int, band: int):
        rows, least = _signatures_of(blobs), _bounds(threshold, miss)
        keys, allowed = band_keys(rows), _parity_bits([x[8 * _WORDS :] for x in blobs], n, threshold)

        def near(i: int, other: np.ndarray) -> np.ndarray:
            other = allowed(i, other[agreeing(rows[i], rows[other], least)])
            shared = np.where(keys[other] == keys[i], keys[other], np.iinfo(np.int64).max)
            return other[shared.min(1, initial=np.iinfo(np.int64).max) == band]

        return near

    return of


def near_duplicates(docs: DataFrame, words: int = 3, threshold: int = 85, miss: float = 1e-7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Documents link when 100 * shared >= threshold * union of their shingles, which is checked on the
    full sets; component_id is the smallest doc_id that can be reached over links, and ``kept`` tells
    whether it is the document's own. A pair at the threshold is missed by all bands once in 10 million times.
    It is pruned after a batch where its posterior chance of reaching the threshold is below ``miss``, which befalls
    a pair that is right at the threshold a few times as often as that; nearer pairs are missed far less often.
    Null, blank and empty texts have no shingles and link with nothing: their component_id is their
    doc_id. Null ids are passed over when the smallest is taken, and are the component's id only where all are null
    (all of which are then kept). Repeated rows are equal sets. Further columns are not read; doc_id must be a whole number.

    Texts are read once for signatures, and again for the sets of candidates that are not pruned. Of a band, Spark
    counts the classes and takes the first before rows move; a band in which very many meet is joined by broadcast
    of its one row (see attach_groups). Sets are known by 64-bit hashes of shingles and of sets.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    summed = written(arrow_map(rows, _summaries(words), "doc_id long, n long, class long, sketch binary"))
    digests = summed.drop("sketch")
    total = digests.count()
    filled = summed.filter("n > 0").groupBy("class")
    classes = written(filled.agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch")))
    bands = written(arrow_map(classes.select("class", "sketch"), _bands, "band long, class long"))
    # bands in which the same classes meet are one: of them, the least is looked at
    met = bands.groupBy("band").agg(F.min("class").alias("hub"), F.count("*").alias("members"), F.expr("bit_xor(xxhash64(class))").alias("who"))
    met = met.filter("members > 1").groupBy("who", "members", "hub").agg(F.min("band").alias("band"))
    meeting = written(attach_groups(bands, written(met.select("band", "hub", "members")), "band", "members", bands.count()).filter("hub is not null"))
    pairs = meeting.filter("class <> hub").select(F.col("hub").alias("a"), F.col("class").alias("b")).distinct()
    signs = classes.select("class", "n", F.col("sketch").alias("tokens"))

    def linked(pairs: DataFrame) -> DataFrame:
        return _where(pairs, _sets_of(rows, classes, _ends(pairs), words, lambda tokens: tokens), _by_set(threshold))

    links = linked(_where(written(pairs), signs, _by_signature(threshold, miss)))
    sizes = classes.select(F.col("class").alias("a"), "n")
    groups = meeting.filter("members > 2").select(F.col("band").alias("group"), F.col("class").alias("a")).join(sizes, "a").withColumn("place", F.lit(0).cast("long"))
    across = _pairs_across(groups, components(links), classes.select("class", "sketch"), threshold, _matcher(miss))
    if not across.isEmpty():
        links = links.unionByName(linked(written(across.distinct())))
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    named = _with_components(digests, classes, links, total).select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return named.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
