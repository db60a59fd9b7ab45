"""Counts, shares, quantiles and other descriptions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """(column, n), nulls left out; the most frequent first, ties by value."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(name)).orderBy(F.desc(name), column)


def share_in_group(df: DataFrame, group: str, column: str) -> DataFrame:
    """(group, column, n, share): the share of each value within its group."""
    n = df.groupBy(group, column).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(group)), 6))


def null_fraction(df: DataFrame, group: str, column: str) -> DataFrame:
    """(group, n_null, support, null_share)."""
    agg = df.groupBy(group).agg(F.sum(F.col(column).isNull().cast("bigint")).alias("n_null"), F.count("*").alias("support"))
    return agg.withColumn("null_share", F.round(F.col("n_null") / F.col("support"), 6))


def length_stats(df: DataFrame, column: str) -> DataFrame:
    """One row of the length of a string column: least, most, mean, deviation and quartiles."""
    n = F.length(column)
    q = lambda p: F.percentile(n, F.lit(p))
    return df.agg(
        F.min(n).cast("bigint").alias("shortest"), F.max(n).cast("bigint").alias("longest"), F.round(F.avg(n), 4).alias("mean"), F.round(F.stddev(n), 4).alias("deviation"),
        q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"),
    )


def quality_summary(df: DataFrame) -> DataFrame:
    """(column, n_null, null_pct, n_distinct) of every column, in one pass over the table."""
    aggs = []
    for c in df.columns:
        aggs += [F.sum(F.col(c).isNull().cast("bigint")).alias(f"{c}_null"), F.count_distinct(c).alias(f"{c}_distinct")]
    one = df.agg(F.count("*").alias("_n"), *aggs)
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}_null").alias("n_null"), F.col(f"{c}_distinct").alias("n_distinct")) for c in df.columns])
    return one.select("_n", F.explode(parts).alias("p")).select("p.column", "p.n_null", F.round(100 * F.col("p.n_null") / F.col("_n"), 4).alias("null_pct"), "p.n_distinct")


def histogram(df: DataFrame, column: str, width: float, log: bool = False) -> DataFrame:
    """(bucket, n): values in steps of ``width``, of their common logarithm if ``log``."""
    x = F.log10(column) if log else F.col(column)
    kept = df.filter(F.col(column) > 0) if log else df.filter(F.col(column).isNotNull())
    return kept.groupBy(F.floor(x / width).cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))


def fences(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """One row (q1, q3, lower, upper): Tukey's fences."""
    q = df.agg(F.percentile(column, F.lit(0.25)).alias("q1"), F.percentile(column, F.lit(0.75)).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return q.select("q1", "q3", (F.col("q1") - k * iqr).alias("lower"), (F.col("q3") + k * iqr).alias("upper"))


def longest_and_shortest(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row: the keys of the longest and the shortest text, ties to the least key."""
    n = F.length(column)
    return df.filter(F.col(column).isNotNull()).agg(F.max_by(key, F.struct(n, -F.col(key))).alias("longest"), F.min_by(key, F.struct(n, F.col(key))).alias("shortest"))


def reduction(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: the share of rows that went."""
    return before.agg(F.count("*").alias("n1")).crossJoin(after.agg(F.count("*").alias("n2"))).select("n1", "n2", F.round(1 - F.col("n2") / F.col("n1"), 6).alias("reduction"))  # one row by one row
