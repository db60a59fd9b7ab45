"""Duplicates: the first row wins, in an order that is named."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the least ``order`` for each value of ``keys``; nulls are one value. ``order`` is unique.

    A hot key is one partial row a task before the shuffle, where a window would sort all its rows in one task.
    """
    packed = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k) for k in keys]).agg(F.min_by(packed, F.col(order)).alias("_row")).select("_row.*")


def first_wins_slim(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The same for wide rows: only the survivors' ``order`` is aggregated, the rows are joined back."""
    survivors = df.groupBy(*[F.col(k) for k in keys]).agg(F.min(order).alias(order)).select(order)
    return df.join(survivors, order, "left_semi")


def chain_first_wins(df: DataFrame, key_sets: list[list[str]], order: str) -> DataFrame:
    """Several key sets one after another; the order of the sets matters."""
    for keys in key_sets:
        df = first_wins(df, keys, order)
    return df


def duplicate_probe(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row (n_rows, n_distinct, n_duplicates)."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"))
