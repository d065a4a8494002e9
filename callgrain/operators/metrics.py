"""Evaluation of scores against labels: ROC and what follows from it, by running sums over distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgrain.operators.ranked import running_down

#: Rates this near count as equal.
NEAR = 1e-12


def per_score(rows: DataFrame) -> DataFrame:
    """(threshold, dt, df): positives and negatives of each distinct score."""
    return rows.groupBy(F.col("score").alias("threshold")).agg(F.sum(F.col("y").cast("long")).alias("dt"), F.sum((1 - F.col("y")).cast("long")).alias("df"))


def roc(rows: DataFrame, drop_intermediate: bool = True) -> DataFrame:
    """(threshold, tps, fps): one point for each distinct score, after (inf, 0, 0).

    Points on a straight line between others can be dropped: a point stays if it is first
    or last, or if the step to the next one differs from the step to it.
    """
    points = running_down(per_score(rows), "threshold", {"dt": "tps", "df": "fps"}, {"dt": "nt", "df": "nf"})
    if drop_intermediate:
        first = (F.col("tps") == F.col("dt")) & (F.col("fps") == F.col("df"))
        points = points.filter(first | F.col("nt").isNull() | (F.col("nt") != F.col("dt")) | (F.col("nf") != F.col("df")))
    start = rows.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("tps"), F.lit(0).cast("long").alias("fps"))
    return start.unionByName(points.select("threshold", "tps", "fps"))


def rates(points: DataFrame) -> DataFrame:
    every = points.agg(F.max("tps").alias("_t"), F.max("fps").alias("_f"))  # one row
    share = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of))
    return points.crossJoin(F.broadcast(every)).select(*points.columns, share("tps", "_t").alias("tpr"), share("fps", "_f").alias("fpr"))


def area(points: DataFrame) -> DataFrame:
    """One row (np, nn, auc): wins of positives over negatives, ties half; null if a class is missing."""
    sums = points.agg(F.sum(F.col("dt") * (F.lit(0) - F.col("fps") + F.col("df") / 2)).alias("w"), F.sum("dt").alias("np"), F.sum("df").alias("nn"))
    auc = (F.col("w") + F.col("np") * F.col("nn")) / (F.col("np") * F.col("nn"))
    return sums.select("np", "nn", F.when((F.col("np") > 0) & (F.col("nn") > 0), auc).alias("auc"))


def auc_of_all(rows: DataFrame) -> DataFrame:
    return area(running_down(per_score(rows), "threshold", {"dt": "tps", "df": "fps"}))


def auc(rows: DataFrame, by: list[str]) -> DataFrame:
    """Area by ranks with ties at their middle, for each of many small groups; null if a class is missing."""
    own = Window.partitionBy(*by).orderBy("score")
    sums = rows.groupBy(*by, "score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    below = sums.withColumn("below", F.sum("n").over(own) - F.col("n"))
    sums = below.groupBy(*by).agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("wins"), F.sum("p").alias("np"), F.sum("n").alias("nn"))
    return sums.select(*by, "np", "nn", F.when((F.col("np") > 0) & (F.col("nn") > 0), F.col("wins") / (F.col("np") * F.col("nn"))).alias("auc"))


def auc_against_all_positives(rows: DataFrame, slices: list[str]) -> DataFrame:
    """Each slice's negatives against the positives of all slices: an equi-join on distinct scores, not pairs."""
    points = running_down(per_score(rows), "threshold", {"dt": "tps"}).select(F.col("threshold").alias("score"), (F.col("tps") - F.col("dt") / 2).alias("won"))
    positives = rows.agg(F.sum("y").alias("np"))  # one row
    negatives = rows.filter("y = 0").groupBy(*slices, "score").agg(F.count("*").alias("n")).join(points, "score")
    sums = negatives.groupBy(*slices).agg(F.sum(F.col("n") * F.col("won")).alias("wins"), F.sum("n").alias("nn")).crossJoin(F.broadcast(positives))
    return sums.select(*slices, F.when(F.col("np") > 0, F.col("wins") / (F.col("np") * F.col("nn"))).alias("auc"))


def at_fpr(points: DataFrame, targets: list[float]) -> DataFrame:
    """(target, hit, threshold) of the last kept point whose false positive rate is within the target."""
    wanted = F.explode(F.array(*[F.lit(t) for t in targets])).alias("target")
    within = rates(points).select("*", wanted).filter(F.col("fpr") <= F.col("target") + NEAR)
    last = F.struct("fps", "tps", (-F.col("threshold")).alias("low"))
    best = within.groupBy("target").agg(F.max(last).alias("b"), F.max_by("tpr", last).alias("hit"))
    return best.select("target", F.coalesce("hit", F.lit(0.0)).alias("hit"), (-F.col("b.low")).alias("threshold"))


def eer(points: DataFrame) -> DataFrame:
    """Equal error rate at the first point of least difference, interpolated from the one before if they bracket it."""
    rows = rates(points).select("fps", "tps", "fpr", (1 - F.col("tpr")).alias("fnr"), (F.col("fpr") - 1 + F.col("tpr")).alias("d"))
    best = rows.agg(F.min(F.struct(F.round(F.abs("d"), 12).alias("far"), "fps", "tps", "fpr", "fnr", "d")).alias("b"))
    earlier = rows.crossJoin(F.broadcast(best)).filter(F.struct("fps", "tps") < F.struct("b.fps", "b.tps"))
    before = earlier.agg(F.max(F.struct("fps", "tps", "fpr", "d")).alias("a"))
    f0, d0, f1, d1 = (F.col(c) for c in ("a.fpr", "a.d", "b.fpr", "b.d"))
    mid = f0 + (f1 - f0) * (-d0) / F.when(d1 != d0, d1 - d0)
    value = F.when(d0 * d1 < 0, mid).otherwise((f1 + F.col("b.fnr")) / 2)
    return best.crossJoin(F.broadcast(before)).select(value.alias("eer"))


def compute(rows: DataFrame, targets: tuple[float, ...] = (0.01, 0.02, 0.05)) -> DataFrame:
    """One row: n, auc, eer and the hit rate at each false positive rate; all null with one class only."""
    points = roc(rows)
    hits = at_fpr(points, list(targets)).groupBy().pivot("target", list(targets)).agg(F.first("hit"))
    named = hits.select(*[F.col(f"`{t}`").alias(f"hit_at_fpr_{round(100 * t)}") for t in targets])
    both = F.col("classes") == 2
    sizes = rows.agg(F.count("*").alias("n"), F.count_distinct("y").alias("classes"))
    wide = sizes.crossJoin(auc_of_all(rows).select("auc")).crossJoin(eer(points)).crossJoin(named)  # of one row each
    return wide.select("n", *[F.when(both, F.col(c)).alias(c) for c in ["auc", "eer", *named.columns]])


def slice_table(rows: DataFrame, dims: list[str], threshold: Column) -> DataFrame:
    """(dim, slice, n, n_relay, recall, fpr, auc_vs_relay) for each value of each dimension; rows come with y and score."""
    spread = rows.select("y", "score", F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit("?")).alias("slice")) for d in dims])).alias("s"))
    spread = spread.select("s.dim", "s.slice", "y", "score")
    hit = (F.col("score") >= threshold).cast("int")
    table = spread.groupBy("dim", "slice").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("n_relay"), F.avg(F.when(F.col("y") == 1, hit)).alias("recall"), F.avg(F.when(F.col("y") == 0, hit)).alias("fpr"))
    points = running_down(per_score(rows), "threshold", {"dt": "tps"}).select(F.col("threshold").alias("score"), (F.col("tps") - F.col("dt") / 2).alias("won"))
    negatives = spread.filter("y = 0").groupBy("dim", "slice", "score").agg(F.count("*").alias("k")).join(points, "score")
    wins = negatives.groupBy("dim", "slice").agg((F.sum(F.col("k") * F.col("won")) / F.sum("k")).alias("wins"))
    positives = rows.agg(F.sum("y").alias("np"))  # one row
    met = table.join(wins, ["dim", "slice"], "left").crossJoin(F.broadcast(positives))
    return met.select(*table.columns, F.when(F.col("np") > 0, F.col("wins") / F.col("np")).alias("auc_vs_relay"))
