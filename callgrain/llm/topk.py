"""Exact top-k search by inner product.

Vectors are ordered by descending length and cut into blocks; queries too are cut
into blocks. Within a block, vectors are rotated by the singular vectors of the whole
table, so that the first few components hold most of an inner product; what is left is at
most the product of the residual lengths (Cauchy-Schwarz). What its bound puts under the
query's k-th best score so far is left out.

The block of the longest vectors is searched first and gives each query a floor. A block
whose longest vector can't reach the floor of any query of a query block is never brought
together with it. Tasks hold one block of vectors and read query blocks one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgrain.llm._shared import arrow_map, partitions, written

#: Vectors in a candidate block, and at most in a query block: what a task holds at once.
BLOCK, QUERIES = 4096, 2048
#: Query blocks that one task compares with a block.
GROUP = 64
#: Candidates whose bounds are computed together.
STEP = 1024
#: If more than this share of pairs passes the bounds, scores are one product of matrices.
DENSE = 0.02
#: Tasks that sum up outer products.
SUMS = 8


def scaled(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)))


def usable(vector: Column) -> Column:
    """Not null, and every component a finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def _gram(vectors: DataFrame, d: int) -> np.ndarray:
    """Sum of outer products over all vectors: d * d numbers from each of SUMS tasks reach the driver."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            m = _matrix(batch.column(0), d)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x).reshape(d, d)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = arrow_map(vectors.select("v"), outer, "sums binary")
    rows = arrow_map(parts.repartition(SUMS), add, "sums binary").collect()
    return sum((np.frombuffer(r.sums).reshape(d, d) for r in rows), np.zeros((d, d)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of whole numbers as doubles, padded with zeros: exact below 2^53."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), d))
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) and (lengths == d).all():
        return values.reshape(-1, d).astype(np.float64)
    at = np.repeat(np.arange(len(column)), lengths)
    out[at, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _blocks(rows: DataFrame, d: int, size: int) -> DataFrame:
    """(block, ids, m, longest): at most ``size`` vectors in each, the longest in the lowest blocks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, ids, rows = TaskContext.get().partitionId() << 20, 0, [], []

        def block() -> pa.RecordBatch:
            m = np.concatenate(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([task + n], pa.int64()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([float((m * m).sum(1).max())])],
                ["block", "ids", "m", "longest"],
            )

        for batch in batches:
            ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            rows.append(_matrix(batch.column(1), d))
            while sum(map(len, ids)) >= size:
                all_ids, all_rows = np.concatenate(ids), np.concatenate(rows)
                ids, rows = [all_ids[:size]], [all_rows[:size]]
                yield block()
                ids, rows, n = [all_ids[size:]], [all_rows[size:]], n + 1
        if sum(map(len, ids)):
            yield block()

    return arrow_map(rows, cut, "block long, ids binary, m binary, longest double")


def _sorted(ids: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -(m * m).sum(1)))
    return ids[order], m[order]


def _pair(ids: np.ndarray, m: np.ndarray, qids: np.ndarray, qm: np.ndarray, floor: np.ndarray, k: int, turn: np.ndarray, head: int) -> pa.RecordBatch:
    """(query_id, vec_id, score): of a block, sorted by descending length, what may be among a query's k best."""
    turned, qturned = m @ turn[:, :head], qm @ turn[:, :head]
    square, qsquare = (m * m).sum(1), (qm * qm).sum(1)
    length, qlength = np.sqrt(square), np.sqrt(qsquare)
    rest, qrest = np.sqrt(np.maximum(square - (turned**2).sum(1), 0)), np.sqrt(np.maximum(qsquare - (qturned**2).sum(1), 0))
    best, found = [np.empty(0, np.int64)] * 3, floor.copy()
    for s in range(0, len(ids), STEP):
        e = min(s + STEP, len(ids))
        slack = 1e-6 * qlength * length[s] + 1e-6  # rounding of the rotated sums
        live = np.flatnonzero(qlength * length[s] + slack >= found)
        if not len(live):
            break  # all that follow are shorter still
        bound = qturned[live] @ turned[s:e].T + qrest[live, None] * rest[None, s:e] + slack[live, None]
        passed = bound >= found[live, None]
        if passed.mean() > DENSE:
            rows, columns = live[passed.any(1)], s + np.flatnonzero(passed.any(0))
            score = qm[rows] @ m[columns].T
            score[qids[rows][:, None] == ids[columns][None, :]] = -np.inf
            least = found[rows]
            if len(columns) > k:
                least = np.maximum(least, np.partition(score, len(columns) - k, axis=1)[:, len(columns) - k])
            q, c = np.nonzero((score >= least[:, None]) & (score > -np.inf))
            score, q, c = score[q, c], rows[q], columns[c]
        else:
            q, c = np.nonzero(passed)
            q, c = live[q], s + c
            q, c = q[own := qids[q] != ids[c]], c[own]
            score = np.einsum("ij,ij->i", qm[q], m[c])
        best = [np.concatenate(x) for x in zip(best, (q, ids[c], score.astype(np.int64)), strict=True)]
        order = np.lexsort((best[1], -best[2], best[0]))
        best = [x[order] for x in best]
        rank = np.arange(len(order)) - np.searchsorted(best[0], best[0])
        best = [x[rank < k] for x in best]
        last = rank[rank < k] == k - 1
        found[best[0][last]] = np.maximum(found[best[0][last]], best[2][last])
    keep = best[2] >= floor[best[0]]
    return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (qids[best[0]], best[1], best[2])], ["query_id", "vec_id", "score"])


def _search(met: DataFrame, d: int, k: int, turn: np.ndarray, head: int) -> DataFrame:
    """(query_id, vec_id, score) over rows (block, group, qblock, ids, m, floors), a block's vectors before its query blocks."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = m = None
        for batch in batches:
            for qblock, own_ids, own, floors in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4, 5)], strict=True):
                vectors, names = np.frombuffer(own).reshape(-1, d), np.frombuffer(own_ids, np.int64)
                if qblock < 0:
                    ids, m = _sorted(names, vectors)
                    continue
                floor = np.frombuffer(floors) if floors else np.full(len(names), -np.inf)
                yield _pair(ids, m, names, vectors, floor, k, turn, head)

    return arrow_map(met, search, "query_id long, vec_id long, score long")


def _brought(pairs: DataFrame, blocks: DataFrame, queries: DataFrame, tasks: int) -> DataFrame:
    """The pairs' blocks, each with its query blocks after it; GROUP query blocks a task."""
    grouped = pairs.withColumn("group", F.expr(f"rank div {GROUP}").cast("int"))
    asked = grouped.join(queries, "qblock").select("block", "group", "qblock", "ids", "m", "floors")
    own = grouped.select("block", "group").distinct().join(blocks, "block")
    own = own.select("block", "group", F.lit(-1).cast("long").alias("qblock"), "ids", "m", F.lit(None).cast("binary").alias("floors"))
    return own.unionByName(asked).repartition(tasks, "block", "group").sortWithinPartitions("block", "group", "qblock")


def _floors(queries: DataFrame, found: DataFrame, k: int, d: int) -> DataFrame:
    """Query blocks with each query's k-th best score so far, and ``need``: the length under which a vector can't reach any of these."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    kth = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k).select("query_id", F.col("score").cast("double").alias("floor"))
    ids = queries.select("qblock", "ids").mapInArrow(_spread, "qblock long, at int, query_id long")
    floor = F.struct("at", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    blobs = ids.join(kth, "query_id", "left").groupBy("qblock").agg(F.transform(F.sort_array(F.collect_list(floor)), lambda x: x.floor).alias("f"))

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], []]
            for m, floors in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                size, f = np.sqrt((np.frombuffer(m).reshape(-1, d) ** 2).sum(1)), np.array(floors)
                with np.errstate(divide="ignore", invalid="ignore"):
                    least = np.where(f <= 0, -np.inf, f / size)
                out[0].append(f.tobytes())
                out[1].append(float(least.min() * (1 - 1e-6)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out[0], pa.binary()), pa.array(out[1], pa.float64())], ["qblock", "ids", "m", "floors", "need"])

    joined = queries.drop("floors").join(blobs, "qblock").select("qblock", "ids", "m", "f")
    return arrow_map(joined, need, "qblock long, ids binary, m binary, floors binary, need double")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, ids in zip(*batch.to_pydict().values(), strict=True):
            ids = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()), pa.array(ids)], ["qblock", "at", "query_id"])


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products, ties to the smaller vec_id.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows
    but the query's own id. Vectors that are null, or hold a null or a non-finite
    component, and rows without an id take no part; an empty vector scores 0. Of two
    vectors, the shorter one counts as padded with zeros. A repeated row is a candidate
    for itself; repeated query rows are one query. Scores are exact while sums of the scaled products stay under 2^53.
    An empty table gives no rows. Further columns are not read.
    """
    spark = vectors.sparkSession
    rows = written(
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("raw"))
        .filter(F.col("id").isNotNull() & usable(F.col("raw")))
        .select("id", scaled(F.col("raw"), scale).cast("array<double>").alias("v"))
        .withColumn("norm", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    )
    n, d = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    d = max(d, 1)
    power, turn = np.linalg.eigh(_gram(rows, d))
    turn, power = turn[:, ::-1], np.cumsum(power[::-1])
    head = int(min(max(1, d // 2), 1 + np.searchsorted(power, 0.8 * power[-1])))
    parts = max(1, -(-n // BLOCK))
    ordered = rows.select("id", "v", "norm").repartitionByRange(parts, F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id").select("id", "v")
    blocks = written(_blocks(ordered, d, BLOCK))
    asked = rows.filter(F.col("id") % every == 0).dropDuplicates(["id"]).select("id", "v")
    # each task gets a query block at least, of QUERIES at most
    size = max(1, min(QUERIES, -(-n // every // partitions(spark))))
    queries = written(_blocks(asked.repartition(max(1, -(-n // every // size)), F.xxhash64("id")), d, size).select(F.col("block").alias("qblock"), "ids", "m", F.lit(None).cast("binary").alias("floors")))
    longest = blocks.agg(F.max_by("block", "longest")).first()[0]
    # the first block goes to every query block: it is BLOCK vectors, whatever the table
    own = blocks.filter(F.col("block") == longest).select("ids", "m").first()
    sent = spark.sparkContext.broadcast(_sorted(np.frombuffer(own.ids, np.int64), np.frombuffer(own.m).reshape(-1, d)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, vectors in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names = np.frombuffer(names, np.int64)
                yield _pair(*sent.value, names, np.frombuffer(vectors).reshape(-1, d), np.full(len(names), -np.inf), k, turn, head)

    tasks = max(1, min(10_000, queries.count()))
    found = written(arrow_map(queries.select("ids", "m").repartition(tasks), first, "query_id long, vec_id long, score long"))
    floors = written(_floors(queries, found, k, d))
    needs = floors.select("qblock", "need")  # 16 bytes for each query block
    left = blocks.filter(F.col("block") != longest).select("block", "longest")
    pairs = left.join(F.broadcast(needs), F.sqrt("longest") >= F.col("need")).select("block", "qblock")
    pairs = written(pairs.withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy("qblock")) - 1))
    groups = pairs.select("block", F.expr(f"rank div {GROUP}")).distinct().count()
    if not groups:
        return _best(found, k).select("query_id", "rank", "vec_id", "score")
    others = _search(_brought(pairs, blocks, floors, max(1, min(10_000, groups))), d, k, turn, head)
    return _best(found.unionByName(others), k).select("query_id", "rank", "vec_id", "score")
