"""Scores of samples, reports over detectors and slices, per-class tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain.operators import metrics as me

#: Labels that count as positive; weights of the two learned detectors.
POSITIVE = ("relay", "real_relay")
LEARNED = {"cnn": 0.35, "gbm": 0.25}
SLICES = ["label", "codec2", "device", "codec_pair"]


def positive(label: Column) -> Column:
    return label.isin(*POSITIVE).cast("int")


def evaluated_split(samples: DataFrame, split: str | None = None) -> DataFrame:
    """Rows of ``split``; without one those of ``test``, or all if there are none."""
    rows = samples.withColumn("split", F.coalesce("split", F.lit("train")))
    if split:
        return rows.filter(F.col("split") == split)
    tested = rows.agg(F.coalesce(F.bool_or(F.col("split") == "test"), F.lit(False)).alias("_tested"))  # one row
    return rows.crossJoin(F.broadcast(tested)).filter(~F.col("_tested") | (F.col("split") == "test")).drop("_tested")


def sample_scores(windows: DataFrame) -> DataFrame:
    """(file, name, score): means over windows of (file, name, score); where a file has both learned detectors, their plain mean too."""
    means = windows.groupBy("file", "name").agg(F.avg("score").alias("score"))
    both = means.filter(F.col("name").isin(*LEARNED)).groupBy("file").agg(F.avg("score").alias("score"), F.count("*").alias("n")).filter(F.col("n") == len(LEARNED))
    return means.unionByName(both.select("file", F.lit("cnn_gbm_avg").alias("name"), "score"))


def fused_scores(windows: DataFrame) -> DataFrame:
    """(file, score): means over windows of the weighted learned detectors; a missing one counts as 0."""
    weight = F.create_map(*[F.lit(x) for kv in LEARNED.items() for x in kv])
    own = windows.filter(F.col("name").isin(*LEARNED)).withColumn("w", weight[F.col("name")])
    each = own.groupBy("file", "win_ix").agg((F.sum(F.col("w") * F.col("score")) / sum(LEARNED.values())).alias("s"))
    return each.groupBy("file").agg(F.avg("s").alias("score"))


def sample_auc(windows: DataFrame, samples: DataFrame) -> DataFrame:
    """(name, auc) over the samples' means."""
    rows = sample_scores(windows).join(samples.select("file", positive(F.col("label")).alias("y")), "file")
    return me.auc(rows, ["name"]).select("name", "auc")


def label_accuracy(rows: DataFrame) -> DataFrame:
    """(label, n, accuracy) at 0.5 for each label that has rows, and ``overall``; rows come with label, y and score."""
    right = ((F.col("score") >= 0.5).cast("int") == F.col("y")).cast("int")
    table = rows.withColumn("right", right).rollup("label").agg(F.count("*").alias("n"), F.round(F.avg("right"), 4).alias("accuracy"), F.grouping("label").alias("all"))
    return table.select(F.when(F.col("all") == 1, "overall").otherwise(F.col("label")).alias("label"), "n", "accuracy")


def class_report(windows: DataFrame, samples: DataFrame) -> DataFrame:
    """(name, label, n_windows, mean_score, auc_vs_relay) of window scores; the area is null for relay itself."""
    rows = windows.join(samples.select("file", "label"), "file").withColumn("y", (F.col("label") == "relay").cast("int"))
    shape = rows.groupBy("name", "label").agg(F.count("*").alias("n_windows"), F.avg("score").alias("mean_score"))
    names = [r["name"] for r in rows.select("name").distinct().orderBy("name").collect()]  # detectors
    areas = [me.auc_against_all_positives(rows.filter(F.col("name") == n), ["label"]).select(F.lit(n).alias("name"), "label", F.col("auc").alias("auc_vs_relay")) for n in names]
    return shape.join(reduce(DataFrame.unionByName, areas), ["name", "label"], "left") if areas else shape.withColumn("auc_vs_relay", F.lit(None).cast("double"))


def report(scores: DataFrame, samples: DataFrame, split: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(overall, slices): metrics of each detector, and its slice tables at the threshold with 2 % false positives.

    scores: (file, name, score). overall: (name, n, auc, eer, hit_at_fpr_*, threshold_at_fpr_2); slices: (name, dim,
    slice, n, n_relay, recall, fpr, auc_vs_relay). The loop is over detectors, of which there are a handful.
    """
    known = [F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in ("codec1", "codec2")]
    kept = evaluated_split(samples, split).withColumn("y", positive(F.col("label"))).withColumn("codec_pair", F.concat_ws("->", *known))
    rows = scores.join(kept.select("file", "y", *SLICES), "file")
    overall, slices = [], []
    for name in [r["name"] for r in rows.select("name").distinct().orderBy("name").collect()]:
        own = rows.filter(F.col("name") == name)
        found = me.at_fpr(me.roc(own), [0.02]).agg(F.coalesce(F.max("threshold"), F.lit(float("inf"))).alias("threshold_at_fpr_2"))
        overall.append(me.compute(own).crossJoin(found).select(F.lit(name).alias("name"), "*"))  # one row each
        limit = found.first()[0]
        slices.append(me.slice_table(own, SLICES, F.lit(limit)).select(F.lit(name).alias("name"), "*"))
    if not overall:
        raise ValueError("no scores to report on")
    return reduce(DataFrame.unionByName, overall), reduce(DataFrame.unionByName, slices)


def markdown(table: DataFrame) -> str:
    """A small report table as Markdown: numbers to four places, a dash for null."""
    show = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    rows = [[show(v) for v in r] for r in table.collect()]
    if not rows:
        return "(no rows)\n"
    return "\n".join("| " + " | ".join(r) + " |" for r in [table.columns, ["---"] * len(table.columns), *rows]) + "\n"
