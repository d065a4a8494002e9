"""Signals, scores, turns and labelled scores, as views of the driver's tables.

"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, i, x): a user's event values in order of event_id."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), (F.row_number().over(order) - 1).alias("i"), F.col("value").alias("x"))


def window_scores(spark: SparkSession, sf_dir: str, hop: int = 5) -> DataFrame:
    """(call_id, win_ix, name, score): of two scores of a name in a window, the later one counts."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    numbered = table(spark, sf_dir, "events").withColumn("win_ix", F.floor((F.row_number().over(order) - 1) / hop))
    return (
        numbered.groupBy(F.col("user_id").alias("call_id"), "win_ix", F.col("event_type").alias("name"))
        .agg(F.max_by("value", "event_id").alias("v"))
        .select("call_id", "win_ix", "name", (F.col("v") / (1 + F.col("v"))).alias("score"))
    )


def context_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, name, score) of whole calls; the name ``error`` is also a window score's."""
    k = F.get_json_object("props", "$.k").cast("double")
    per_call = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("call_id")).agg((F.avg(k) / 100).alias("score"))
    return per_call.select("call_id", F.explode(F.array(F.lit("error"), F.lit("context_k"))).alias("name"), "score")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, turn_ix, role, start_s, end_s): turns laid end to end by text length; every third has a gap before it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.char_length("text").cast("double").alias("n"))
    gap = F.when(F.pmod(F.col("turn"), F.lit(3)) == 2, 5.0).otherwise(0.25)
    end = F.sum(F.col("n") + gap).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(F.col("conv_id").alias("call_id"), F.col("turn").alias("turn_ix"), "role", (end - F.col("n")).alias("start_s"), end.alias("end_s"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, y, lang, source, score): documents with a quality label, scored by length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    score = F.pmod(F.col("n_chars"), F.lit(97)).cast("double") / 97
    return rows.select("doc_id", F.col("quality").alias("y"), "lang", "source", score.alias("score"))


def spectrum_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, frame): 64 samples."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("frame"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, samples): a tone of 220 Hz with overtones, 512 samples for each value of a user, as loud as the value, which counts up to 100."""
    tone = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda t: F.sin(t * 0.0864) * 0.6 + F.sin(t * 0.1728) * 0.3 + F.sin(t * 0.9) * 0.1)
    wave = F.lit(spark.range(1).select(tone).first()[0])  # computed once and not for each value
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.pow(F.least(F.col("value"), F.lit(100.0)) / 100, 2).alias("loud"))
    events = events.repartition(4 * spark.sparkContext.defaultParallelism, "user_id")
    # values are gathered as numbers, and become samples where a call's row is read: so samples are neither sorted nor spilled
    values = events.groupBy(F.col("user_id").alias("call_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "loud"))), lambda s: s.loud).alias("values"))
    return values.select("call_id", F.flatten(F.transform("values", lambda a: F.transform(wave, lambda s: s * a))).alias("samples"))
