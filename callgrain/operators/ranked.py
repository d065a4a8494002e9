"""Running sums and ranks over a whole table, without one task that holds it.

Rows are dealt to ranges of the order, each range is summed and ordered in a task of its
own, and what lies before a range is added: a table of one row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a hash: ranks within one are taken in one task.
HASH_RANGES = 4096


def ranges(rows: DataFrame, value: str) -> Column:
    """The number of the range that a value is in, highest values first; the cuts are a table's quantiles."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.approxQuantile(value, [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > F.col(value))) if cuts else F.lit(0)


def running_down(rows: DataFrame, value: str, sums: dict[str, str], coming: dict[str, str] | None = None) -> DataFrame:
    """Adds running sums in descending order of ``value``, which is distinct; and, as ``coming``, the next row's values.

    sums and coming: the new column's name by that of the column.
    """
    coming = coming or {}
    placed = rows.withColumn("_range", ranges(rows, value))
    top = F.struct(value, *coming)
    whole = placed.groupBy("_range").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums], F.max(top).alias("_top"))
    order = Window.orderBy("_range")  # one row for each range
    before = [F.coalesce(F.sum(f"_s_{c}").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_b_{c}") for c in sums]
    starts = whole.select("_range", *before, *[F.lead(F.col("_top")[c]).over(order).alias(f"_n_{c}") for c in coming])
    own = Window.partitionBy("_range").orderBy(F.desc(value))
    met = placed.join(F.broadcast(starts), "_range")  # shuffle partitions many rows at most
    out = [F.col(f"_b_{c}") + F.sum(c).over(own) for c in sums]
    nxt = [F.coalesce(F.lead(c).over(own), F.col(f"_n_{c}")) for c in coming]
    names = [*sums.values(), *coming.values()]
    return met.select(*rows.columns, *[c.alias(n) for c, n in zip([*out, *nxt], names, strict=True)])


def hash_rank(rows: DataFrame, by: list[str], key: Column, tie: str) -> DataFrame:
    """Adds ``r``, from 1, and ``n``: places in the order of the key's md5 within groups, one of which may be hot.

    A group is ordered in HASH_RANGES parts by the first digits of the digest.
    """
    digest = rows.withColumn("_digest", F.md5(key.cast("binary"))).withColumn("_part", F.conv(F.substring("_digest", 1, 3), 16, 10).cast("int"))
    counts = digest.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*by, "_part", before.alias("_before"), F.sum("_n").over(group).alias("n"))
    own = Window.partitionBy(*by, "_part").orderBy("_digest", tie)
    ranked = digest.withColumn("_own", F.row_number().over(own)).join(starts, [*by, "_part"])
    return ranked.select(*rows.columns, (F.col("_own") + F.col("_before")).alias("r"), "n")


def _fused(a: Column, s: Column, c: Column) -> Column:
    """a * s + c with one rounding, by sums and products whose errors are known; the plain value where that can't be told."""

    def halves(x: Column) -> tuple[Column, Column]:
        wide = x * 134217729.0
        high = wide - (wide - x)
        return high, x - high

    (ah, al), (sh, sl), p = halves(a), halves(s), a * s
    lost = ((ah * sh - p) + ah * sl + al * sh) + al * sl
    total = p + c
    moved = total - p
    exact = total + ((p - (total - moved)) + (c - moved) + lost)
    return F.when(F.isnan(exact), total).otherwise(exact)


def quantiles(rows: DataFrame, value: str, cuts: dict[str, float], by: str = "call_id") -> DataFrame:
    """Adds a group's quantiles of ``value``, by name; nulls don't count.

    Between the two values next to it a quantile is low * (1 - d) + high * d, the first product not rounded, as the SQL's engine
    has it: percentile() differs in the last bit, which decides where a value lies right at a limit.
    """
    own = Window.partitionBy(by)
    found = rows.withColumn("_r", F.row_number().over(own.orderBy(F.col(value).asc_nulls_last()))).withColumn("_n", F.count(value).over(own))
    for name, q in cuts.items():
        at = (F.col("_n") - 1) * F.lit(q)
        near = lambda place: F.max(F.when(F.col("_r") == place + 1, F.col(value))).over(own)  # noqa: B023, E731
        found = found.withColumn("_low", near(F.floor(at))).withColumn("_high", near(F.ceil(at)))
        d = at - F.floor(at)
        met = _fused(F.col("_low"), 1 - d, F.col("_high") * d)
        found = found.withColumn(name, F.when(F.floor(at) == F.ceil(at), F.col("_low")).otherwise(met))
    return found.select(*rows.columns, *cuts)
