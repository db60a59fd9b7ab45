"""Balanced one-vs-rest linear classifiers, search by successive halving, and the mean-vector model."""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sgd import LOSSES, PENALTIES, SCHEDULES, Sgd
from .vectorize import text_stages

#: Steps of a row's lot.
LOTS = 1_000_000
#: Rows that one task of a rung may hold at least: each fit goes over its rows many times, in a job a step.
ROWS_A_TASK = 2_000
#: Fits of a rung at a time: on few rows each is a chain of short jobs of a task or two.
TOGETHER = 9


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): weight n / (k * n_c), so that all classes weigh the same."""
    n = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_n"), F.count("*").alias("_k"))
    return n.crossJoin(F.broadcast(total)).select(label, "n", F.round(F.col("_n") / (F.col("_k") * F.col("n")), 6).alias("weight"))  # one row


def with_weights(df: DataFrame, label: str) -> DataFrame:
    return df.drop("weight").join(class_weights(df, label).select(label, "weight"), label)


def linear(kind: str = "svm", alpha: float = 1e-4, penalty: str = "l2", parallelism: int = 4, **kw) -> Pipeline:
    """A pipeline from (text, label, weight) to a prediction: hinge or logistic loss, l1 (logistic only) or l2."""
    if kind == "svm":
        if penalty != "l2":
            raise ValueError("hinge loss has an l2 penalty only")
        each = LinearSVC(regParam=alpha, standardization=False, maxIter=30, weightCol="weight")
        head = OneVsRest(classifier=each, labelCol="target", featuresCol="features", weightCol="weight", parallelism=parallelism)
    else:
        head = LogisticRegression(regParam=alpha, elasticNetParam=1.0 if penalty == "l1" else 0.0, standardization=False, maxIter=30, weightCol="weight", labelCol="target", featuresCol="features")
    return Pipeline(stages=[*text_stages(**kw), StringIndexer(inputCol="label", outputCol="target", stringOrderType="alphabetAsc", handleInvalid="skip"), head])


def set_params(pipeline: Pipeline, **kw) -> Pipeline:
    """A copy of a pipeline with ``step__param`` values: the step by its class's name in small letters, ``head`` for the
    last one and ``each`` for the classifier that a one-vs-rest head repeats."""
    out = pipeline.copy()
    stages = [s.copy() for s in out.getStages()]
    named = {type(s).__name__.lower(): s for s in stages} | {"head": stages[-1]}
    if hasattr(stages[-1], "getClassifier"):
        named["each"] = stages[-1].getClassifier().copy()
    for name, value in kw.items():
        step, _, param = name.partition("__")
        if step not in named or not named[step].hasParam(param):
            raise ValueError(f"no such step or parameter: {name}")
        named[step].set(named[step].getParam(param), value)
    if "each" in named:
        stages[-1].setClassifier(named["each"])
    return out.setStages(stages)


def labelled(model: PipelineModel, predictions: DataFrame) -> DataFrame:
    """Predictions with the class's name as ``predicted``."""
    names = model.stages[-2].labels
    return predictions.withColumn("predicted", F.element_at(F.array(*[F.lit(x) for x in names]), F.col("prediction").cast("int") + 1))


def accuracy(predictions: DataFrame) -> float:
    return MulticlassClassificationEvaluator(labelCol="target", metricName="accuracy").evaluate(predictions)


def _drawn(rng: random.Random, kinds: tuple[str, ...]) -> dict:
    """A setting by chance: kind, alpha log-uniform, and what else its kind may choose."""
    setting = {"kind": rng.choice(kinds), "alpha": 10 ** rng.uniform(-6, -2)}
    if setting["kind"] != "svm":
        setting["penalty"] = rng.choice(PENALTIES)
    if setting["kind"] == "sgd":
        setting |= {"loss": rng.choice(LOSSES), "schedule": rng.choice(SCHEDULES), "average": rng.random() < 0.5}
    return setting


def _scored(setting: dict, train: DataFrame, test: DataFrame) -> float:
    if setting["kind"] != "sgd":
        return accuracy(linear(**setting, min_df=1.0).fit(train).transform(test))
    said = Sgd(steps=15, **{k: v for k, v in setting.items() if k != "kind"}).fit(train).transform(test, ["label"])
    right, n = said.agg(F.sum((F.col("label") == F.col("predicted")).cast("double")), F.count("*")).first()
    return float(right or 0) / n if n else 0.0


def halving_search(df: DataFrame, key: str, grid: int = 6, factor: int = 3, first: int = 200, seed: int = 1, kinds: tuple[str, ...] = ("svm", "log")) -> list[dict]:
    """Random settings on ever larger samples, the best 1 / factor of them kept each time; best first.

    The last rung is always the whole table: a single survivor goes there at once.
    The settings are few, so the loop over them is the driver's; fits and scores are Spark's.
    """
    rng = random.Random(seed)
    total = df.count()
    left = [_drawn(rng, kinds) for _ in range(grid)]
    n, rung, results = min(first, total), 0, []
    while left:
        # a bound on the row's lot takes about n rows without a sort
        some = df if n >= total else df.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(LOTS)) < n * LOTS // total)
        part = with_weights(some, "label").coalesce(max(1, math.ceil(n / ROWS_A_TASK))).cache()
        n = part.count()
        train, test = part.filter(F.pmod(F.xxhash64(key), F.lit(4)) > 0), part.filter(F.pmod(F.xxhash64(key), F.lit(4)) == 0)
        with ThreadPoolExecutor(min(len(left), TOGETHER)) as pool:  # the fits of a rung don't need each other
            scored = list(zip(pool.map(inheritable_thread_target(df.sparkSession)(lambda setting: _scored(setting, train, test)), left), left, strict=True))
        results += [{**setting, "rung": rung, "n": n, "score": score} for score, setting in scored]
        part.unpersist()
        if n >= total:
            break
        keep = max(1, math.ceil(len(left) / factor))
        left = [s for _, s in sorted(scored, key=lambda x: -x[0])[:keep]]
        n, rung = total if len(left) == 1 else min(n * factor, total), rung + 1
    return sorted(results, key=lambda r: (-r["rung"], -r["score"]))


def cv_table(spark: SparkSession, results: list[dict]) -> DataFrame:
    rows = [({k: f"{v:.3e}" if isinstance(v, float) else str(v) for k, v in r.items() if k not in ("rung", "n", "score")}, r["rung"], r["n"], float(r["score"])) for r in results]
    return spark.createDataFrame(rows, "params map<string,string>, rung int, n int, score double")


def mean_vectors(weights: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(label, term, coef): the mean TF-IDF vector of each class."""
    of = labels.filter(F.col(label).isNotNull()).select(key, label)
    n = of.groupBy(label).agg(F.count("*").alias("_n"))
    return weights.join(of, key).groupBy(label, "term").agg(F.sum("weight").alias("_s")).join(n, label).select(label, "term", (F.col("_s") / F.col("_n")).alias("coef"))


def decide(weights: DataFrame, coef: DataFrame, key: str, label: str) -> DataFrame:
    """(key, predicted, score): the class of the largest product, ties by name.

    Each term's coefficients lie in one row, a column a class, and are summed per text, so that what is shuffled grows
    with the terms alone and not with terms times classes. The classes are read first: they are few.
    """
    classes = sorted(r[0] for r in coef.select(label).distinct().collect())
    if not classes:
        return weights.select(key, F.lit(None).cast("string").alias("predicted"), F.lit(None).cast("double").alias("score")).limit(0)
    wide = coef.groupBy("term").pivot(label, classes).agg(F.first("coef"))
    wide = wide.select("term", *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(classes)])
    sums = weights.join(wide, "term").groupBy(key).agg(*[F.sum(F.col("weight") * F.col(f"_c{i}")).alias(f"_c{i}") for i in range(len(classes))])
    ranked = F.array(*[F.struct((-F.round(f"_c{i}", 9)).alias("s"), F.lit(c).alias("c")) for i, c in enumerate(classes)])
    best = F.array_min(F.filter(ranked, lambda x: x["s"].isNotNull()))
    return sums.withColumn("_b", best).filter(F.col("_b").isNotNull()).select(key, F.col("_b.c").alias("predicted"), (-F.col("_b.s")).alias("score"))
