"""Collocations by pointwise mutual information, and phrases joined into one token."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut_lineage, spread


def bigrams(df: DataFrame, tokens: str, keep: list[str]) -> DataFrame:
    """(keep.., a, b) of neighbours within a document, built within the row, without a window."""
    t = F.col(tokens)
    pairs = F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.struct(F.element_at(t, i).alias("a"), F.element_at(t, i + 1).alias("b")))
    return df.filter(F.size(t) > 1).select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.a", "_p.b")


def pmi(df: DataFrame, tokens: str, group: str, least: int) -> DataFrame:
    """(group, a, b, n, pmi): log2 of how much more often a bigram comes than by chance within its group."""
    single = df.select(F.col(group), F.explode(tokens).alias("t")).groupBy(group, "t").agg(F.count("*").alias("n"))
    total = single.groupBy(group).agg(F.sum("n").alias("_total"))
    both = bigrams(df, tokens, [group]).groupBy(group, "a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    a = single.select(F.col(group), F.col("t").alias("a"), F.col("n").alias("na"))
    b = single.select(F.col(group), F.col("t").alias("b"), F.col("n").alias("nb"))
    scored = both.join(a, [group, "a"]).join(b, [group, "b"]).join(total, group)
    return scored.select(group, "a", "b", "n", F.round(F.log2(F.col("n") * F.col("_total") / (F.col("na") * F.col("nb"))), 6).alias("pmi"))


def top_half(scored: DataFrame, group: str, least: float = 0.5, width: float = 1 / 64) -> DataFrame:
    """The upper part of each group by percent rank of its score; a group of one row has rank 0.

    Counts of score intervals tell which of them the bound lies in, so that only that one's rows are ranked, and not a
    whole group in one task. A null score has no rank.
    """
    bucket = F.floor(F.col("pmi") / width)
    told = scored.filter(F.col("pmi").isNotNull()).withColumn("_b", bucket)
    counts = told.groupBy(group, "_b").agg(F.count("*").alias("_n"))  # as many rows a group as there are intervals
    by = Window.partitionBy(group)
    counts = counts.withColumn("_all", F.sum("_n").over(by)).withColumn("_before", F.coalesce(F.sum("_n").over(by.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    need = F.lit(least) * (F.col("_all") - 1)
    counts = counts.withColumn("_sure", (F.col("_before") >= need) & ((F.col("_all") > 1) | F.lit(least <= 0))).filter(F.col("_sure") | (F.col("_before") + F.col("_n") > need))
    marked = told.join(counts.select(F.col(group).alias("_g"), F.col("_b").alias("_c"), "_all", "_before", "_sure"), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_c")))
    edge = marked.filter(~F.col("_sure") & (F.col("_all") > 1)).withColumn("_r", F.rank().over(Window.partitionBy(group, "_b").orderBy("pmi")) - 1)
    return marked.filter("_sure").select(*scored.columns).unionByName(edge.filter(F.col("_before") + F.col("_r") >= need).select(*scored.columns))


def join_bigrams(tokens: Column, phrases: Column) -> Column:
    """Tokens with neighbours that are a phrase joined by ``_``, greedily from the left.

    ``phrases`` is an array of ``a b`` strings; the fold carries the tokens so far and the one that waits.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("last"))

    def step(acc: Column, t: Column) -> Column:
        hit = acc["last"].isNotNull() & F.array_contains(phrases, F.concat_ws(" ", acc["last"], t))
        flush = F.when(acc["last"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"])))
        return F.when(hit, F.struct(F.concat(acc["done"], F.array(F.concat_ws("_", acc["last"], t))).alias("done"), F.lit(None).cast("string").alias("last"))).otherwise(F.struct(flush.alias("done"), t.alias("last")))

    folded = F.aggregate(tokens, start, step, lambda acc: F.when(acc["last"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"]))))
    return folded


def mwe_join(df: DataFrame, key: str, tokens: str, phrases: DataFrame, most: int = 500_000) -> DataFrame:
    """(key, tokens) with bigram phrases (a, b) joined greedily from the left; every row stays, without tokens too.

    Up to ``most`` phrases, which are counted first, go to the tasks, and each row is joined by itself without a
    shuffle. A longer list is met by an equality join of the bigrams that occur, with the same result.
    """
    known = cut_lineage(phrases.select("a", "b").distinct())  # counted and read
    if known.count() <= most:
        return mwe_join_any(df, key, tokens, [(r["a"], r["b"]) for r in known.toLocalIterator()])
    return mwe_join_large(df, key, tokens, known)


def mwe_join_large(df: DataFrame, key: str, tokens: str, phrases: DataFrame) -> DataFrame:
    """The same for a phrase list of any size: nothing of it is sent to the driver.

    Matches that follow each other without a gap are an island; in it every other one counts, from the left.
    """
    placed = df.select(key, F.posexplode_outer(tokens).alias("i", "t"))
    by = Window.partitionBy(key).orderBy("i")
    placed = placed.withColumn("nxt", F.lead("t").over(by))
    known = phrases.select(F.col("a").alias("t"), F.col("b").alias("nxt")).distinct().withColumn("hit", F.lit(True))
    hits = placed.join(known, ["t", "nxt"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    island = F.col("i") - F.row_number().over(Window.partitionBy(key, "hit").orderBy("i"))
    hits = hits.withColumn("isl", F.when(F.col("hit"), island))
    odd = F.row_number().over(Window.partitionBy(key, "hit", "isl").orderBy("i")) % 2 == 1
    hits = hits.withColumn("take", F.col("hit") & odd)
    eaten = F.coalesce(F.lag("take").over(by), F.lit(False))
    out = hits.withColumn("eaten", eaten).filter(~F.col("eaten")).select(key, "i", F.when(F.col("take"), F.concat_ws("_", "t", "nxt")).otherwise(F.col("t")).alias("t"))
    words = F.filter(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"].isNotNull())
    return out.groupBy(key).agg(F.transform(words, lambda x: x["t"]).alias(tokens))


def mwe_join_any(df: DataFrame, key: str, tokens: str, phrases: list[tuple[str, ...]]) -> DataFrame:
    """The same for phrases of any length, by a trie in batches; the longest phrase wins. The list is a parameter."""
    trie: dict = {}
    for p in phrases:
        node = trie
        for w in p:
            node = node.setdefault(w, {})
        node[None] = True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for words in pdf[tokens]:
                out, i, words = [], 0, list(words) if words is not None else []
                while i < len(words):
                    node, end = trie, 0
                    for j in range(i, len(words)):
                        node = node.get(words[j])
                        if node is None:
                            break
                        if None in node:
                            end = j + 1
                    end = end or i + 1
                    out.append("_".join(words[i:end]))
                    i = end
                rows.append(out)
            yield pd.DataFrame({key: pdf[key], tokens: rows})

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, tokens)).mapInPandas(run, f"`{key}` {kind}, `{tokens}` array<string>")


def brand_phrases(df: DataFrame, brand: str, stop: list[str], least: int = 10) -> DataFrame:
    """(phrase ARRAY, n): brands of ``least`` products or more with two words or more that aren't stopwords."""
    n = df.groupBy(brand).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    words = F.filter(F.split(brand, "_"), lambda t: ~t.isin(*stop) & (t != ""))
    return n.select(words.alias("phrase"), "n").filter(F.size("phrase") >= 2).groupBy("phrase").agg(F.sum("n").alias("n"))
