"""Evaluation of (label, predicted) tables, and reading of coefficients."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame) -> DataFrame:
    """(label, predicted, n, share of the label)."""
    n = df.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("label")), 6))


def report(df: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of each class."""
    n = df.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    real = n.groupBy("label").agg(F.sum("n").alias("support"))
    said = n.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("_said"))
    hit = n.filter(F.col("label") == F.col("predicted")).select("label", F.col("n").alias("_hit"))
    t = real.join(said, "label", "left").join(hit, "label", "left").na.fill(0, ["_said", "_hit"])
    p = F.when(F.col("_said") > 0, F.col("_hit") / F.col("_said")).otherwise(0.0)
    r = F.col("_hit") / F.col("support")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return t.select("label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), "support")


def report_summary(classes: DataFrame) -> DataFrame:
    """(average, precision, recall, f1) as the macro and the weighted mean of a report."""
    total = F.sum("support")
    macro = classes.select(F.lit("macro").alias("average"), "precision", "recall", "f1").groupBy("average").agg(*[F.round(F.avg(c), 5).alias(c) for c in ("precision", "recall", "f1")])
    weighted = classes.groupBy(F.lit("weighted").alias("average")).agg(*[F.round(F.sum(F.col(c) * F.col("support")) / total, 5).alias(c) for c in ("precision", "recall", "f1")])
    return macro.unionByName(weighted)


def accuracy_pair(df: DataFrame) -> DataFrame:
    """One row (accuracy, balanced_accuracy); the balanced one is the mean recall."""
    each = df.groupBy("label").agg(F.sum((F.col("label") == F.col("predicted")).cast("bigint")).alias("_h"), F.count("*").alias("_n"))
    return each.agg(F.round(F.sum("_h") / F.sum("_n"), 6).alias("accuracy"), F.round(F.avg(F.col("_h") / F.col("_n")), 6).alias("balanced_accuracy"))


def coefficients(model: PipelineModel) -> DataFrame:
    """(label, term, coef) of a fitted one-vs-rest pipeline; its vocabulary is the model's own size."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    vectorizer = next(s for s in model.stages if hasattr(s, "vocabulary"))
    head, names = model.stages[-1], model.stages[-2].labels
    vectors = np.array([m.coefficients.toArray() for m in head.models]) if hasattr(head, "models") else head.coefficientMatrix.toArray()
    if len(vectors) == 1:
        vectors = np.concatenate([-vectors, vectors])
    label, term = np.nonzero(vectors)
    return spark.createDataFrame(pd.DataFrame({"label": np.array(names, object)[label], "term": np.array(vectorizer.vocabulary, object)[term], "coef": vectors[label, term]}), "label string, term string, coef double")


def is_fitted(model: object) -> bool:
    return isinstance(model, PipelineModel) and len(model.stages) > 0


def top_terms(coef: DataFrame, label: str, k: int) -> DataFrame:
    """(label, term, coef, rank): the k largest of each class, ties by term."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.desc(F.round("coef", 9)), "term")).cast("bigint")
    return coef.withColumn("rank", rank).filter(F.col("rank") <= k)
