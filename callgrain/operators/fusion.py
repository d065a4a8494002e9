"""From detector scores to a verdict: calibration, precedence, weights, guardrails, smoothing, states."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-9


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def clip01(x: Column) -> Column:
    return F.when(F.isnan(x), 0.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def calibrate(scores: DataFrame, calibrators: DataFrame) -> DataFrame:
    """p = sigmoid(a * score + b), or the calibrator's constant; unknown names are clipped to [0, 1]. Calibrators are a row a detector."""
    if "constant" not in calibrators.columns:
        calibrators = calibrators.withColumn("constant", F.lit(None).cast("double"))
    known = scores.join(F.broadcast(calibrators.select("name", "a", "b", "constant")), "name", "left")
    fitted = F.when(F.col("a").isNotNull(), sigmoid(F.col("a") * F.col("score") + F.col("b")))
    return known.withColumn("p", F.coalesce(fitted, "constant", clip01(F.col("score")))).drop("a", "b", "constant")


def with_context(windows: DataFrame, context: DataFrame) -> DataFrame:
    """Adds each call's own scores to its windows; a window's score of the same name counts instead.

    A window's scores become a map, and the call's map is added to it: one grouping and one join.
    """
    as_map = F.map_from_entries(F.collect_list(F.struct("name", "p")))
    own = windows.groupBy("call_id", "win_ix").agg(as_map.alias("own"))
    call = context.groupBy("call_id").agg(as_map.alias("call"))
    added = F.map_filter("call", lambda k, _: ~F.map_contains_key("own", k))
    every = own.join(call, "call_id", "left").withColumn("every", F.when(F.col("call").isNull(), F.col("own")).otherwise(F.map_concat("own", added)))
    return every.select("call_id", "win_ix", F.explode("every").alias("name", "p")).select(*windows.columns)


def combine(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean over the detectors that have a weight; else the plain mean, else 0.5."""
    w = scores.join(F.broadcast(weights), "name", "left")
    weighted = F.sum(F.col("w") * F.col("p")) / F.sum(F.when(F.col("w").isNotNull(), F.col("w")))
    return w.groupBy("call_id", "win_ix").agg(clip01(F.coalesce(weighted, F.avg("p"), F.lit(0.5))).alias("fused"))


def guard(fused: DataFrame, flags: DataFrame) -> DataFrame:
    """Background first takes 0.25 off, then noise suppression draws towards 0.5."""
    rows = fused.join(flags, "call_id", "left")
    quiet = F.when(F.coalesce("background", F.lit(False)), F.greatest(F.lit(0.0), F.col("fused") - 0.25)).otherwise(F.col("fused"))
    return rows.withColumn("fused", F.when(F.coalesce("suppressed", F.lit(False)), 0.5 + (quiet - 0.5) * 0.85).otherwise(quiet))


def ordered(fused: DataFrame) -> DataFrame:
    items = F.transform(F.array_sort(F.collect_list(F.struct("win_ix", "fused"))), lambda x: x.fused)
    return fused.groupBy("call_id").agg(items.alias("s"))


def ema(values: Column, alpha: float = 0.4) -> Column:
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), values[0], lambda e, s: alpha * s + (1 - alpha) * e)


def ema_trace(fused: DataFrame, alpha: float = 0.4, value: str = "fused") -> DataFrame:
    """(call_id, step, smoothed): every smoothed value of each call, in one pass over its windows in order."""

    def trace(rows: pd.DataFrame) -> pd.DataFrame:
        rows, e, out = rows.sort_values("win_ix"), None, []
        for s in rows[value]:
            e = s if e is None else alpha * s + (1 - alpha) * e
            out.append(e)
        return pd.DataFrame({"call_id": rows.call_id.to_numpy(), "step": range(len(out)), "smoothed": out})

    kind = fused.schema["call_id"].dataType.simpleString()
    return fused.select("call_id", "win_ix", value).groupBy("call_id").applyInPandas(trace, f"call_id {kind}, step long, smoothed double")


def state(score: Column, green: float, red: float) -> Column:
    return F.when(score >= red - EPS, "RED").when(score >= green - EPS, "CHALLENGE").otherwise("GREEN")


def confidence(score: Column, now: Column, green: float, red: float) -> Column:
    """The score itself when RED, what it lacks to 1 when GREEN, else half and the distance from the nearer threshold."""
    margin = F.least(score - green, red - score) / max(red - green, 1e-6)
    return clip01(F.when(now == "RED", score).when(now == "GREEN", 1 - score).otherwise(0.5 + margin))


def verdicts(fused: DataFrame, green: float, red: float, benign: DataFrame | None = None) -> DataFrame:
    """(call_id, score, state, confidence); calls in ``benign`` (call_id, benign) never go beyond CHALLENGE."""
    score = ordered(fused).select("call_id", ema(F.col("s")).alias("score"))
    now = state(F.col("score"), green, red)
    if benign is not None:
        score = score.join(benign, "call_id", "left")
        now = F.when(F.coalesce("benign", F.lit(False)) & (now == "RED"), "CHALLENGE").otherwise(now)
    rows = score.withColumn("state", now)
    return rows.select("call_id", "score", "state", confidence(F.col("score"), F.col("state"), green, red).alias("confidence"))


def top_reasons(scores: DataFrame, weights: DataFrame, k: int = 3) -> DataFrame:
    """The k detectors with the largest weight * distance of the mean from 0.5, with their means; without a weight it is 0."""
    mean = scores.groupBy("call_id", "name").agg(F.avg("p").alias("mean_p")).join(F.broadcast(weights), "name", "left")
    pull = mean.withColumn("pull", F.round(F.coalesce("w", F.lit(0.0)) * F.abs(F.col("mean_p") - 0.5), 9))
    own = Window.partitionBy("call_id").orderBy(F.desc("pull"), "name")
    top = pull.withColumn("r", F.row_number().over(own)).filter(F.col("r") <= k)
    said = F.struct("r", F.format_string("%s=%.2f", F.col("name"), F.col("mean_p")).alias("said"))
    texts = F.transform(F.array_sort(F.collect_list(said)), lambda x: x["said"])
    return top.groupBy("call_id").agg(F.concat(F.lit("top detectors: "), F.array_join(texts, ", ")).alias("reason"))
