"""The language cache kept up by a stream of new listings: each micro-batch fills only what the cache doesn't hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.language_filter import detect
from ..sources.io import exists


def keep_cache(spark: SparkSession, listings: DataFrame, cache: str, state: str, key: str = "asin", text: str = "text") -> StreamingQuery:
    """Runs over the available rows of a stream (key, text) and adds (key, lang, batch) to the table at ``cache``.

    A batch that runs again after a failure replaces its own part, so each key is added once.
    """

    def fill(batch: DataFrame, number: int) -> None:
        schema = f"`{key}` string, lang string, batch bigint"  # the first batch finds no table
        known = spark.read.schema(schema).parquet(cache).filter(F.col("batch") != number) if exists(spark, cache) else spark.createDataFrame([], schema)
        new = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(text).alias(text)).join(known.select(key), key, "left_anti")
        found = new.select(key).join(detect(new, key, text).select(key, "lang"), key, "left")
        found.write.mode("overwrite").parquet(f"{cache}/batch={number}")

    return listings.writeStream.foreachBatch(fill).option("checkpointLocation", state).trigger(availableNow=True).start()
