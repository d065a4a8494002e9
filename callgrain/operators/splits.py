"""Deterministic splits, seeds, shards, hold-outs and resumable plans: hashes instead of random draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgrain.operators.ranked import hash_rank


def md5_mod100(key: Column) -> Column:
    """The 128-bit digest modulo 100, from its two halves: 2^64 leaves 16."""
    digest = F.md5(key.cast("binary"))

    def half(start: int) -> Column:
        high = F.conv(F.substring(digest, start, 8), 16, 10).cast("long")
        low = F.conv(F.substring(digest, start + 8, 8), 16, 10).cast("long")
        return ((high % 100) * 96 + low % 100) % 100  # 2^32 leaves 96

    return (half(1) * 16 + half(17)) % 100


def speaker_split(key: Column) -> Column:
    bucket = md5_mod100(key)
    return F.when(bucket < 80, "train").when(bucket < 90, "dev").otherwise("test")


def two_level_split(key: Column) -> Column:
    test = md5_mod100(F.concat(F.lit("test:"), key)) < 15
    dev = md5_mod100(F.concat(F.lit("dev:"), key)) < 10
    return F.when(test, "test").when(dev, "dev").otherwise("train")


def sample_seed(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def remaining(planned: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return planned.join(done.select(key), key, "left_anti")


def existing(rows: DataFrame, files: DataFrame, key: str) -> DataFrame:
    return rows.join(files.select(key), key, "left_semi")


def other_group(rows: DataFrame, id_col: str, group_col: str) -> DataFrame:
    """For each row a partner from the next group in order, by position in it: an equi-join, not a theta join.

    Positions are those of the ids' hashes, so a hot group is ordered by several tasks. What is
    ordered as a whole are the distinct groups.
    """
    ranked = hash_rank(rows.select(id_col, group_col), [group_col], F.col(id_col).cast("string"), id_col).withColumn("r", F.col("r") - 1)
    sizes = rows.groupBy(group_col).agg(F.count("*").alias("n"))
    order = Window.orderBy(group_col)
    first = Window.orderBy(group_col).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(first))
    partners = sizes.select(group_col, nxt(group_col).alias("partner_group"), nxt("n").alias("partner_n"))
    wanted = ranked.select(id_col, group_col, "r").join(partners, group_col).filter(F.col(group_col) != F.col("partner_group"))
    wanted = wanted.withColumn("r", F.col("r") % F.col("partner_n"))
    there = ranked.select(F.col(id_col).alias("partner_id"), F.col(group_col).alias("partner_group"), "r")
    return wanted.join(there, ["partner_group", "r"]).select(id_col, "partner_id", "partner_group")


def stratified(rows: DataFrame, index: Column) -> DataFrame:
    """Adds ``want``: of each ten in order, eight train, one dev, one test."""
    at = F.pmod(index, F.lit(10))
    return rows.withColumn("want", F.when(at < 8, "train").when(at == 8, "dev").otherwise("test"))


def seventy_thirty(rows: DataFrame, by: list[str], key: Column, tie: str, least: int = 10) -> DataFrame:
    """Adds ``part``: train for 70 % of each group in a hashed order, else holdout; all of a small group are both."""
    ranked = hash_rank(rows, by, key, tie)
    part = F.when(F.col("n") < least, "in-sample").when(F.col("r") <= F.greatest(F.lit(1), F.floor((7 * F.col("n") + 5) / 10)), "train").otherwise("holdout")
    return ranked.withColumn("part", part).drop("r", "n")


def hash_limit(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """n rows in the order of a hash: a top-n, so tasks send n rows each at most."""
    return rows.orderBy(F.md5(key.cast("binary")), key).limit(n)


def oversample(rows: DataFrame, times: Column) -> DataFrame:
    return rows.select("*", F.explode(F.sequence(F.lit(1), F.round(times).cast("int"))).alias("copy"))
