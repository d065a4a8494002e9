"""Queries that need kernels or fitted models: the driver checks their rows only, the tests their values."""

from __future__ import annotations

from pyspark.sql import functions as F

from callgrain.operators import context as cx
from callgrain.operators import learning as le
from callgrain.operators import splits as sl
from callgrain.plans.registry import query
from callgrain.sources import tables as src


@query()
def q_features(spark, sf_dir):
    """Windows of two seconds: each value of the stand-in signal lasts 512 samples, so that one has many frames.

    A call's values are few bytes before they become samples, so calls are dealt out by number and not by size.
    """
    calls = src.signal(spark, sf_dir).groupBy("call_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x / 500).alias("values"))
    calls = calls.repartition(4 * spark.sparkContext.defaultParallelism, "call_id")
    calls = calls.select("call_id", F.flatten(F.transform("values", lambda x: F.array_repeat(x, 512))).alias("samples"))
    return cx.call_features(calls, 32000, 16000)


@query()
def q_clusters(spark, sf_dir):
    rows = src.spectrum_input(spark, sf_dir)
    return cx.voices(rows.select(F.floor(F.col("vec_id") / 25).alias("call_id"), F.col("vec_id").alias("turn_ix"), "frame"), 0.5)


@query()
def q_platt_fit(spark, sf_dir):
    a, b, constant = cx.platt(src.labelled(spark, sf_dir))
    return spark.createDataFrame([(a, b, constant)], "a double, b double, constant double")


@query()
def q_gbt_scores(spark, sf_dir):
    """Boosted trees, fitted on 70 % of the labelled documents of each source; scores of the others."""
    rows = src.labelled(spark, sf_dir).withColumn("n_source", F.regexp_extract("source", "([0-9]+)", 1).cast("double"))
    parts = sl.seventy_thirty(rows, ["source"], F.col("doc_id").cast("string"), "doc_id").withColumnRenamed("score", "first")
    score, *_ = le.boosted(parts.filter("part <> 'holdout'"), None, ["first", "n_source"], rounds=5)
    return score(parts.filter("part <> 'train'")).select("doc_id", "y", F.round("score", 6).alias("gbm"))
