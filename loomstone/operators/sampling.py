"""Samples, splits and top rows that come out the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: str, seed: str) -> Column:
    """A row's lot: the MD5 of the seed and its key."""
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))


def sample_fixed(df: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    return df.orderBy(draw(key, seed), key).limit(n)


def stratified_split(df: DataFrame, key: str, stratum: str, train: float = 0.75, seed: str = "49") -> DataFrame:
    """``is_train`` beside each row: of every stratum the rounded share with the least lots; null is a stratum.

    Counts of the lots' first three digits tell in which of their 4,096 intervals the bound of each stratum lies. Only
    the rows of that interval are ordered, so a stratum of a third of all rows is sorted by no single task.
    """
    lot = draw(key, seed)
    told = df.withColumn("_lot", lot).withColumn("_b", F.substring("_lot", 1, 3))
    counts = told.groupBy(F.col(stratum).alias("_s"), "_b").agg(F.count("*").alias("_n"))
    by = Window.partitionBy("_s")
    counts = counts.withColumn("_quota", F.round(F.lit(train) * F.sum("_n").over(by)).cast("bigint"))
    counts = counts.withColumn("_upto", F.sum("_n").over(by.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))
    edge = counts.filter(F.col("_upto") >= F.col("_quota")).groupBy("_s").agg(F.min_by(F.struct(F.col("_b").alias("at"), (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("left")), "_b").alias("_e"))
    marked = told.join(edge, F.col(stratum).eqNullSafe(F.col("_s"))).select(*df.columns, "_lot", "_b", "_e.at", "_e.left")
    sure = marked.filter(F.col("_b") != F.col("at")).withColumn("is_train", F.col("_b") < F.col("at"))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("_lot", key))
    close = marked.filter(F.col("_b") == F.col("at")).withColumn("is_train", rank <= F.col("left"))
    return sure.unionByName(close).select(*df.columns, "is_train")


def split_by_lot(df: DataFrame, key: str, train: float = 0.75, seed: int = 49) -> DataFrame:
    """``is_train`` by the row's lot alone: no shuffle, shares only nearly exact."""
    return df.withColumn("is_train", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(train * 1_000_000))


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint")).filter(F.col("rank") <= k)


def one_per_group(df: DataFrame, group: str, key: str, seed: str = "0", but: list | None = None) -> DataFrame:
    """(group, key): a row of each group by lot, keys in ``but`` left out."""
    some = df.filter(~F.col(key).isin(*but)) if but else df
    return some.filter(F.col(group).isNotNull()).groupBy(group).agg(F.min_by(key, F.struct(draw(key, seed), F.col(key))).alias(key))
