"""Repair of brand names and the gazetteer."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def repair_brand(c: Column) -> Column:
    """Placeholders to null, the leading ``by`` off, the name out of a shop page's title."""
    c = X.collapse_space(F.lower(c))
    c = F.when(c.isin(*X.NULL_BRANDS), None).otherwise(c)
    c = X.strip_prefix(c)
    return F.coalesce(X.extract(c, r"^visit (?:the|amazon's) (.+) (?:store|page)$"), c)


def top_brands(df: DataFrame, brand: str, most: int = 100) -> DataFrame:
    """The most frequent brands of one word of more than three letters, at most ``most``: (brand, support)."""
    n = df.filter(F.col(brand).isNotNull()).groupBy(F.col(brand).alias("brand")).agg(F.count("*").alias("support"))
    return n.filter(~F.col("brand").rlike(r"\s") & (F.col("brand") != "various") & (F.length("brand") > 3)).orderBy(F.desc("support"), "brand").limit(most)


def gazetteer_fill(df: DataFrame, brand: str, title: str, most: int = 100) -> DataFrame:
    """Null brands filled by the most frequent top brand that the title begins with.

    The patterns are at most ``most`` words, read to the driver, and become one alternation in order of support.
    """
    words = [r["brand"] for r in top_brands(df, brand, most).collect()]
    if not words:
        return df
    pattern = r"^(" + "|".join(re.escape(w) for w in words) + r")(?![\p{L}\p{N}_])"
    return df.withColumn(brand, F.coalesce(F.col(brand), X.extract(F.lower(title), pattern)))


def brand_token(c: Column) -> Column:
    """Brand words joined by an underscore; ``none`` for null and blank ones."""
    words = F.regexp_extract_all(X.force_ascii(F.lower(c)), F.lit(r"\w\w+"), 0)
    return F.when(F.size(words) > 0, F.array_join(words, "_")).otherwise(F.lit("none"))
