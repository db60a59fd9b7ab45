"""Problem 4, beside the parser: runs of words that several pages share, as a suffix array over all of them finds them.

A word lies in a repeated run of ``least`` words or more exactly if one of the windows of ``least`` words that hold it
occurs on another page. So instead of one sorted array of all suffixes, which no task could hold, the windows are
counted by their hashes; runs of any length are the unions of the windows that count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut_lineage


def repeated_runs(df: DataFrame, key: str, text: str, least: int = 8, host: str | None = None) -> DataFrame:
    """(key, n_words, n_repeated, unique_text): of each row its words, those in runs shared with another row, the others.

    ``text`` is a string or an array of strings, whose words follow each other. With ``host`` only rows of one host are
    held against each other, a null host being one. Null and empty texts have no words and an empty rest. Windows meet
    by two hashes of 64 bits; a window is one partial row a task before it is shuffled, however often it is told.
    """
    plain = F.array_join(text, " ") if isinstance(df.schema[text].dataType, T.ArrayType) else F.col(text)
    words = F.regexp_extract_all(F.coalesce(plain, F.lit("")), F.lit(r"\S+"), 0)
    rows = cut_lineage(df.select(F.col(key).alias("_k"), (F.col(host) if host else F.lit(None).cast("string")).alias("_h"), words.alias("_w")))
    places = F.transform(F.sequence(F.lit(1), F.size("_w") - (least - 1)), lambda i: F.struct(i.alias("i"), F.array_join(F.slice("_w", i, least), " ").alias("s")))
    windows = rows.filter(F.size("_w") >= least).select("_k", "_h", F.explode(places).alias("_x")).select("_k", F.col("_x.i").alias("i"), F.xxhash64("_h", "_x.s").alias("a"), F.xxhash64(F.lit(1), "_h", "_x.s").alias("b"))
    shared = windows.groupBy("a", "b").agg(F.min("_k").alias("_lo"), F.max("_k").alias("_hi")).filter(F.col("_lo") < F.col("_hi")).select("a", "b")
    covered = windows.join(shared, ["a", "b"], "left_semi").groupBy("_k").agg(F.collect_set("i").alias("_p"))  # at most the words of a row
    told = rows.join(covered, "_k", "left")
    at = F.array_distinct(F.flatten(F.transform(F.coalesce("_p", F.array().cast("array<int>")), lambda i: F.sequence(i, i + (least - 1)))))
    rest = F.filter("_w", lambda w, i: ~F.array_contains(F.col("_at"), i + 1))
    return told.withColumn("_at", at).select(F.col("_k").alias(key), F.size("_w").cast("bigint").alias("n_words"), F.size("_at").cast("bigint").alias("n_repeated"), F.array_join(rest, " ").alias("unique_text"))
