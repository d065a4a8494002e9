"""Speech masks, runs, gaps and turns, by windows over (call_id, i)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgrain.operators.ranked import quantiles


def _call():
    return Window.partitionBy("call_id")


#: Seconds of silence that part two turns.
MERGE_GAP = 0.35


def adaptive_mask(sig: DataFrame, quantile: float = 0.2, above: float = 10.0) -> DataFrame:
    """Speech where the level is more than ``above`` over the call's low quantile."""
    return quantiles(sig, "x", {"_floor": quantile}).withColumn("speech", F.col("x") > F.col("_floor") + above).drop("_floor")


def speech_mask(frames: DataFrame, flattest: float = 0.5, crossings: tuple[float, float] = (0.005, 0.45)) -> DataFrame:
    """The same over (call_id, i, rms_db, flatness, zcr), where the spectrum is not flat and signs change as in speech."""
    mask = adaptive_mask(frames.withColumn("x", F.col("rms_db")))
    return mask.withColumn("speech", F.col("speech") & (F.col("flatness") < flattest) & F.col("zcr").between(*crossings)).drop("x")


def chosen_mask(context: DataFrame, fallback: DataFrame) -> DataFrame:
    """(call_id, i, speech): the first mask of a call if it has any speech, else the second."""
    any_speech = context.withColumn("any", F.bool_or("speech").over(_call()))
    other = fallback.select("call_id", "i", F.col("speech").alias("other"))
    return any_speech.join(other, ["call_id", "i"]).select("call_id", "i", F.when(F.col("any"), F.col("speech")).otherwise(F.col("other")).alias("speech"))


def to_samples(mask: DataFrame, frame: int) -> DataFrame:
    """(call_id, i, speech) of frames as one of samples: frames explode, no range join."""
    at = F.explode(F.sequence(F.col("i") * frame, (F.col("i") + 1) * frame - 1)).alias("i")
    return mask.select("call_id", "speech", at).select("call_id", "i", "speech")


def numbered(segments: DataFrame) -> DataFrame:
    """(call_id, turn_ix, start_s, end_s)."""
    ix = F.row_number().over(_call().orderBy("start_s")) - 1
    return segments.select("call_id", ix.cast("long").alias("turn_ix"), "start_s", "end_s")


def fallback_mask(sig: DataFrame, floor: float = -45.0, above: float = 6.0, flat: float = 6.0) -> DataFrame:
    """Speech over an absolute floor, or over the low quantile if the call is not flat."""
    low, high = F.col("_floor"), F.col("_top")
    limit = F.when(high - low < flat, F.lit(floor)).otherwise(F.greatest(F.lit(floor), low + above))
    return quantiles(sig, "x", {"_floor": 0.2, "_top": 0.95}).withColumn("speech", F.col("x") > limit).drop("_floor", "_top")


def runs(mask: DataFrame) -> DataFrame:
    """(call_id, speech, first_i, last_i, n): maximal runs of equal mask values."""
    own = Window.partitionBy("call_id", "speech").orderBy("i")
    island = mask.withColumn("island", F.col("i") - F.row_number().over(own))
    return island.groupBy("call_id", "speech", "island").agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.count("*").alias("n")).drop("island")


def hangover(mask: DataFrame, longest: int) -> DataFrame:
    """Fills runs of silence inside a call of ``longest`` frames at most."""
    found = runs(mask)
    ends = found.withColumn("low", F.min("first_i").over(_call())).withColumn("high", F.max("last_i").over(_call()))
    fill = ~F.col("speech") & (F.col("n") <= longest) & (F.col("first_i") > F.col("low")) & (F.col("last_i") < F.col("high"))
    filled = ends.withColumn("speech", F.col("speech") | fill)
    return filled.select("call_id", "speech", F.explode(F.sequence("first_i", "last_i")).alias("i"))


def speech_segments(mask: DataFrame, shortest: int) -> DataFrame:
    return runs(mask).filter(F.col("speech") & (F.col("n") >= shortest)).drop("speech")


def merge_gaps(segments: DataFrame, gap: float) -> DataFrame:
    """(call_id, start_s, end_s, parts) of segments joined where the gap is under ``gap``; equal is not joined."""
    order = _call().orderBy("start_s")
    new = F.coalesce((F.col("start_s") - F.lag("end_s").over(order) >= gap).cast("int"), F.lit(1))
    numbered = segments.withColumn("new", new).withColumn("part", F.sum("new").over(order))
    return numbered.groupBy("call_id", "part").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("parts")).drop("part")


def cut_runs(segments: DataFrame, shortest: float, longest: float) -> DataFrame:
    """Pieces of ``longest`` at most; a rest stays if it has ``shortest``."""
    k = F.explode(F.sequence(F.lit(0), F.floor((F.col("end_s") - F.col("start_s")) / longest).cast("int"))).alias("piece")
    pieces = segments.select("call_id", "start_s", "end_s", k).withColumn("from_s", F.col("start_s") + F.col("piece") * longest)
    pieces = pieces.withColumn("to_s", F.least("end_s", F.col("from_s") + longest))
    return pieces.filter(F.col("to_s") - F.col("from_s") >= shortest).select("call_id", "from_s", "to_s")


def gap_stats(turns: DataFrame, long_gap: float = 2.5) -> DataFrame:
    order = _call().orderBy("turn_ix")
    gaps = turns.withColumn("gap", F.col("start_s") - F.lag("end_s").over(order)).filter("gap is not null")
    gaps = quantiles(gaps, "gap", {"p50": 0.5, "p95": 0.95})
    share: Column = F.avg((F.col("gap") > long_gap).cast("double"))
    return gaps.groupBy("call_id").agg(
        F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("std_gap"), F.first("p50").alias("p50_gap"), F.first("p95").alias("p95_gap"), share.alias("long_share")
    )


def interval_grid(turns: DataFrame, step: float) -> DataFrame:
    """Grid points with whether a turn covers them, ends included: points come from the turns, without a range join."""
    k = F.sequence(F.ceil(F.col("start_s") / step), F.floor(F.col("end_s") / step))
    inside = F.when(F.ceil(F.col("start_s") / step) <= F.floor(F.col("end_s") / step), k)
    covered = turns.select("call_id", F.explode(inside).alias("k")).groupBy("call_id", "k").agg(F.lit(True).alias("speech"))
    ends = turns.groupBy("call_id").agg(F.floor(F.max("end_s") / step).alias("last"))
    grid = ends.select("call_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("k"))
    return grid.join(covered, ["call_id", "k"], "left").select("call_id", "k", F.coalesce("speech", F.lit(False)).alias("speech"))
