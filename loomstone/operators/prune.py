"""Rows and categories cut by where they lie in a distribution. Bounds are inclusive and nulls stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trim_quantile(df: DataFrame, values: dict[str, Column], lower: float = 0.0, upper: float = 1.0) -> DataFrame:
    """Rows whose every value lies between its quantiles; the bounds are those of the whole input, in one aggregate."""
    bounds = df.agg(*[F.percentile(v, F.lit(q)).alias(f"_{n}_{s}") for n, v in values.items() for s, q in (("lo", lower), ("hi", upper))])
    keep = F.lit(True)
    for n, v in values.items():
        keep = keep & (v.isNull() | v.between(F.col(f"_{n}_lo"), F.col(f"_{n}_hi")))
    return df.crossJoin(F.broadcast(bounds)).filter(keep).select(*df.columns)  # one row


def trim_central(df: DataFrame, values: dict[str, Column], inner: float) -> DataFrame:
    """The central share ``inner``, as much cut on either side."""
    return trim_quantile(df, values, (1 - inner) / 2, 1 - (1 - inner) / 2)


def trim_iqr(df: DataFrame, value: Column, k: float = 1.5) -> DataFrame:
    """Rows within Tukey's fences."""
    q = df.agg(F.percentile(value, F.lit(0.25)).alias("_q1"), F.percentile(value, F.lit(0.75)).alias("_q3"))
    iqr = F.col("_q3") - F.col("_q1")
    return df.crossJoin(F.broadcast(q)).filter(value.isNull() | value.between(F.col("_q1") - k * iqr, F.col("_q3") + k * iqr)).select(*df.columns)  # one row


def prune_small(df: DataFrame, category: str, least: int) -> DataFrame:
    """Rows whose category has at least ``least`` rows. The counts are aggregated first, so a hot category is no window."""
    kept = df.groupBy(category).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(category)
    return df.join(kept, category, "left_semi")


def prune_quantile(df: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """Of each group the rows whose value is as frequent in it as the quantile ``q`` of its values' counts, or more."""
    n = df.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    bound = n.groupBy(F.col("_g").alias("_h")).agg(F.percentile("_n", F.lit(q)).alias("_q"))
    kept = n.join(bound, F.col("_g").eqNullSafe(F.col("_h"))).filter(F.col("_n") >= F.col("_q")).select("_g", "_v")
    return df.join(kept, F.col(group).eqNullSafe(F.col("_g")) & (F.col(value) == F.col("_v")), "left_semi")


def brand_policy(df: DataFrame, group: str, brand: str, none: str = "none", exempt: int = 1000, keep_share: float = 0.95, q: float = 0.99) -> DataFrame:
    """Small groups stay whole. In others the rows without brand go, unless they are nearly all, then rare brands go.

    A group without any such row counts as if they were all, so none go for that.
    """
    sized = df.groupBy(group).agg(F.count("*").alias("_n"), F.avg((F.col(brand) == none).cast("double")).alias("_share"))
    share = F.when(F.col("_share") == 0, 1.0).otherwise(F.col("_share"))
    sized = sized.select(F.col(group).alias("_g"), "_n", share.alias("_share"))
    told = df.join(sized, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    small = told.filter(F.col("_n") <= exempt).select(*df.columns)
    large = told.filter((F.col("_n") > exempt) & ~((F.col(brand) == none) & (F.col("_share") < keep_share))).select(*df.columns)
    return small.unionByName(prune_quantile(large, group, brand, q))


def window_counts(df: DataFrame, group: str) -> DataFrame:
    """``group_size`` beside each row."""
    return df.withColumn("group_size", F.count("*").over(Window.partitionBy(group)))
