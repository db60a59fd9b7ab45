"""Binary TF-IDF as a long table (document, term, weight), and the same as stages of a pipeline."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def term_frequency(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, term, tf)."""
    return df.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def tfidf(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, term, weight): binary, smooth IDF ln((n+1)/(df+1))+1, rows of length 1."""
    pairs = df.select(key, F.explode(F.array_distinct(tokens)).alias("term"))
    n = df.filter(F.size(tokens) > 0).agg(F.count("*").alias("_n"))
    idf = pairs.groupBy("term").agg(F.count("*").alias("_df")).crossJoin(F.broadcast(n)).select("term", (F.log((F.col("_n") + 1) / (F.col("_df") + 1)) + 1).alias("idf"))  # one row
    weighted = pairs.join(idf, "term")
    norm = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("_norm"))
    return weighted.join(norm, key).select(key, "term", (F.col("idf") / F.col("_norm")).alias("weight"))


class AddTermFrequency(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """idf + 1: adds the binary term vector to its IDF-weighted one, which Spark's IDF leaves out.

    ``inputCol`` names the two vectors, separated by a comma: counts and weighted counts.
    """

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        counts, weighted = self.getInputCol().split(",")
        both = F.zip_with(vector_to_array(F.col(counts)), vector_to_array(F.col(weighted)), lambda a, b: a + b)
        return dataset.withColumn(self.getOutputCol(), array_to_vector(both))


def text_stages(text: str = "text", smooth: bool = False, min_df: float = 2.0, size: int = (1 << 31) - 1) -> list:
    """Tokens of 2 to 16 letters, binary counts of all terms, IDF and unit length. ``smooth`` adds 1 to the IDF, over dense arrays."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"(?i)[\p{L}_]{2,16}", gaps=False, toLowercase=True),
        CountVectorizer(inputCol="_tokens", outputCol="_tf", binary=True, minDF=min_df, vocabSize=size),
        IDF(inputCol="_tf", outputCol="_idf"),
    ]
    if smooth:
        stages.append(AddTermFrequency(inputCol="_tf,_idf", outputCol="_sum"))
    return [*stages, Normalizer(inputCol="_sum" if smooth else "_idf", outputCol="features", p=2.0)]


def text_pipeline(**kw) -> Pipeline:
    return Pipeline(stages=text_stages(**kw))
