"""Helpers that several corpus operators share: shared storage, filters, words.

Nothing here depends on the size of the corpus: filters have a fixed upper size,
written tables live in the folder that all executors see, and the word helpers
work on one bounded chunk of texts at a time.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch. Texts can be long, so the default of 10,000 rows is too many.
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20
#: Bytes that one memo of a worker takes, and the letters of the longest text it remembers.
MEMO_BYTES, MEMO_LETTERS = 32 << 20, 64
#: Bytes of text that the numpy helpers take at once.
CHUNK_BYTES = 4 << 20
#: One bitmap of ``bitmap_construct_agg`` has 4 KB.
BITMAP_BITS = 32768
#: Groups at least this large, and at most HEAVY_GROUPS of them, are joined by broadcast.
HEAVY_GROUPS = 10_000

A_TO_Z, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name below ``spark.checkpoint.dir``.

    The setting is read from the session. Only a local session may lack it
    (tests do); then ``/tmp/checkpoints`` stands in for it.
    """
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file:///tmp/checkpoints"
    return f"{top.rstrip('/')}/callgrain-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe when executors go."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session has ended before the interpreter
        return


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of texts small, unless the session already has them smaller.

    The session keeps these two settings, since plans read them when they run.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key).rstrip("bB")  # with another unit it is the user's own
    if held.isdigit() and int(held) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


class Memo(dict):
    """What a worker remembers of short texts between tasks: MEMO_BYTES at most by estimate.

    It has a newer and an older half. When the newer one is full it becomes the older one, and what
    was in that and has not been asked for since is forgotten.
    """

    def __init__(self, most: int = MEMO_BYTES) -> None:
        super().__init__()
        self.most, self.held, self.old = most, 0, {}

    def keep(self, text: str, value: int) -> None:
        if len(text) > MEMO_LETTERS:
            return
        size = 160 + len(text)  # of a place in the table, a short text and a number
        if self.held + size > self.most // 2:
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += size
        self[text] = value

    def older(self, text: str) -> object | None:
        """What is known from the older half; then it is new again."""
        if (value := self.old.get(text)) is not None:
            self.keep(text, value)
        return value


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` does that for ASCII texts, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, A_TO_Z, LOWER)
    )


# --- Filters of bounded size -------------------------------------------------------


def filter_bits(keys: int, per_key: int = 16, most: int = 1 << 27) -> int:
    """Bits for a filter of that many keys: a power of two, 16 MB at most.

    A full filter lets more rows through, never fewer, so results don't depend on it.
    """
    bits = BITMAP_BITS
    while bits < min(keys * per_key, most):
        bits *= 2
    return bits


def bitmap_table(slots: DataFrame) -> DataFrame:
    """Bitmaps (bucket, bits) of column ``slot``: one row for each 32,768 slots."""
    return (
        slots.select(
            F.expr(f"slot div {BITMAP_BITS}").alias("bucket"),
            F.expr(f"slot % {BITMAP_BITS}").alias("at"),
        )
        .repartition("bucket")
        .groupBy("bucket")
        .agg(F.expr("bitmap_construct_agg(at)").alias("bits"))
    )


def bitmap_bytes(slots: DataFrame, bits: int) -> np.ndarray:
    """The same as one array of ``bits / 8`` bytes on the driver, to be broadcast."""
    out = np.zeros(bits // 8, np.uint8)
    step = BITMAP_BITS // 8
    for row in bitmap_table(slots).collect():  # as many bytes as the filter has
        out[row.bucket * step : (row.bucket + 1) * step] = np.frombuffer(row.bits, np.uint8)
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


# --- Groups, one of which may hold a third of the rows -----------------------------


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of their group, or nulls; a key in ``rows`` may be hot.

    groups has a row for each key. Those of at least total / HEAVY_GROUPS rows are
    fewer than HEAVY_GROUPS, which bounds what is broadcast; the rest is small
    groups, which a shuffled join takes evenly.
    """
    least = max(64, -(-total // HEAVY_GROUPS))
    heavy = groups.filter(F.col(size) >= least)
    light = groups.filter(F.col(size) < least)
    names = [c for c in groups.columns if c != key]
    marked = rows.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), key, "left")
    done = marked.filter(F.col("_heavy")).drop("_heavy")
    rest = marked.filter(F.col("_heavy").isNull()).drop("_heavy", *names)
    return done.unionByName(rest.join(light.hint("merge"), key, "left"))


# --- Words and their hashes ---------------------------------------------------------


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spreads the bits of 64-bit hashes (a multiply-and-shift finaliser)."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes, at the place of the first.

    Runs are put together from runs of powers of two: r(a + b) = r(a) * B^b + r(b).
    """
    mask, power, size, at = 0xFFFFFFFFFFFFFFFF, 0x2545F4914F6CDD1D, 1, hashes
    out, done, rest = None, 0, n
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                if out is None:
                    out, done = at, size
                else:
                    keep = max(0, len(hashes) - done - size + 1)
                    out = out[:keep] * np.uint64(power) + at[done : done + keep]
                    done += size
            rest >>= 1
            if rest:
                keep = max(0, len(at) - size)
                at = at[:keep] * np.uint64(power) + at[size : size + keep]
                power, size = power * power & mask, size * 2
    return out[: max(0, len(hashes) - n + 1)]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of the list with about ``limit`` bytes each; a longer text is one alone."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def text_bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def arrow_map(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def binary_rows(parts: dict[int, list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    """A row for each bucket; each column is an array as bytes."""
    keys = list(parts)
    columns = [pa.array(keys, pa.int32())] + [
        pa.array([parts[k][i].tobytes() for k in keys], pa.binary()) for i in range(len(names))
    ]
    return pa.RecordBatch.from_arrays(columns, ["bucket", *names])


def gathered(batches: Iterator[pa.RecordBatch], kinds: tuple) -> Iterator[list[np.ndarray]]:
    """Each bucket's arrays, put together. Rows come sorted by bucket, so one bucket is held at a time."""
    at, parts = None, [[] for _ in kinds]
    for batch in batches:
        for bucket, *blobs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if bucket != at and parts[0]:
                yield [np.frombuffer(b"".join(x), t) for x, t in zip(parts, kinds, strict=True)]
                parts = [[] for _ in kinds]
            at = bucket
            for held, blob in zip(parts, blobs, strict=True):
                held.append(blob)
    if parts[0]:
        yield [np.frombuffer(b"".join(x), t) for x, t in zip(parts, kinds, strict=True)]


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows with equal keys in one task, one key after the other."""
    return rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def by_bucket(bucket: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """The columns cut up by bucket: few rows of many values, so that Spark moves arrays."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.array([], np.int64)
    ends = np.r_[starts[1:], len(b)][: len(starts)]
    sorted_columns = [c[order] for c in columns]
    return binary_rows(
        {int(b[s]): [c[s:e] for c in sorted_columns] for s, e in zip(starts, ends, strict=True)}, names
    )
