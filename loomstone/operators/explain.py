"""Why a text got its class: the product of its weights with the class's coefficients."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keyword_query


def attribution(weights: DataFrame, coef: DataFrame, predictions: DataFrame, key: str, label: str) -> DataFrame:
    """(key, term, score): each term's part in the score of the predicted class."""
    of = predictions.select(key, F.col("predicted").alias(label))
    return weights.join(of, key).join(coef, ["term", label]).select(key, "term", (F.col("weight") * F.col("coef")).alias("score"))


def scaled(scores: DataFrame, key: str) -> DataFrame:
    """Scores of each text scaled to 0..1; equal scores are all 0."""
    by = Window.partitionBy(key)
    lo, hi = F.min("score").over(by), F.max("score").over(by)
    return scores.withColumn("scaled", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(0.0))


def top_keywords(scores: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(key, keywords, query): the k best terms of each text and the search that they make."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "term"))
    best = scores.withColumn("_r", rank).filter(F.col("_r") <= k)
    words = F.transform(F.array_sort(F.collect_list(F.struct("_r", "term"))), lambda x: x["term"])
    return best.groupBy(key).agg(words.alias("keywords")).withColumn("query", keyword_query(F.col("keywords")))
