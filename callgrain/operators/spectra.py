"""Spectra of short frames: one transform a batch, and what follows from it by higher-order functions. No shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def power(frames: DataFrame, n: int = 64, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """Adds ``p``: the squared magnitudes of bins 0 to n/2, a batch of frames at a time. A null frame stays null."""
    rows = frames.select(*keep, F.col("frame").cast("array<double>").alias("frame"))

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.zeros(n) if x is None else np.resize(np.pad(x, (0, max(0, n - len(x)))), n) for x in batch.column(len(keep)).to_pylist()]
            p = np.abs(np.fft.rfft(np.array(values).reshape(-1, n), axis=1)) ** 2
            lists = pa.array([None if own is None else list(x) for own, x in zip(batch.column(len(keep)).to_pylist(), p, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], lists], [*keep, "p"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(transform, f"{kinds}, p array<double>")


def long_power(frames: DataFrame) -> DataFrame:
    return power(frames).select("vec_id", F.posexplode("p").alias("bin", "p"))


def band_ratio(p: Column, low: int, high: int) -> Column:
    """Share of bins [low, high)."""
    return total(F.slice(p, low + 1, high - low)) / (total(p) + 1e-12)


def centroid(p: Column) -> Column:
    return total(F.transform(p, lambda x, k: x * k)) / (total(p) + 1e-12)


def spread(p: Column, centre: Column) -> Column:
    return F.sqrt(total(F.transform(p, lambda x, k: x * F.pow(k - centre, 2))) / (total(p) + 1e-12))


def rolloff(long: DataFrame, share: float) -> DataFrame:
    """Bins whose running sum is under ``share`` of the frame's power."""
    order = Window.partitionBy("vec_id").orderBy("bin")
    sums = long.withColumn("upto", F.sum("p").over(order)).withColumn("all", F.sum("p").over(Window.partitionBy("vec_id")))
    return sums.groupBy("vec_id").agg(F.count_if(F.col("upto") < share * F.col("all")).alias("rolloff"))


def flatness(p: Column) -> Column:
    logs = F.transform(p, lambda x: F.ln(x + 1e-12))
    return F.exp(total(logs) / F.size(p)) / (total(p) / F.size(p) + 1e-12)


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation; 0 where one side is constant."""
    sides = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(sides > 1e-12, F.covar_pop(x, y) / F.when(sides > 1e-12, sides)).otherwise(0.0)


def slope(y: str, x: str) -> Column:
    var = F.var_pop(x)
    return F.when(var > 1e-12, F.covar_pop(y, x) / F.when(var > 1e-12, var)).otherwise(0.0)
