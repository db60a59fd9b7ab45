"""Tokenisers, token filters and the vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of the trade that say nothing of a product's class.
DOMAIN_WORDS = """additional address addresses apo asin best buy cash com customer deal deliver delivered delivery detail dimensions discontinued eligible feature fpo guarantee item listed money na none package ounce ounces
pound pounds premium price product purchase quality review reviewed reviewer reviews sale sales save savings ship ships shipment shipments shipped shipper shipping specification support value weight within""".split()
#: English function words.
FUNCTION_WORDS = """about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have having he her
here hers herself him himself his how if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs
them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves""".split()
#: Pieces that contractions leave behind.
PIECES = "ain aren couldn didn doesn hadn hasn haven isn ll ma mightn mustn needn re shan shouldn ve wasn weren won wouldn".split()
STOPWORDS = frozenset(DOMAIN_WORDS + FUNCTION_WORDS + PIECES)

#: Python's ``\w``, in which marks aren't, and its ``[a-z]`` without case, in which four more letters are. Java's ``(?U)\w`` holds marks.
_WORD, _LETTER = r"\p{L}\p{N}_", "A-Za-z_\u0130\u0131\u017f\u212a"
WORDS_UNICODE = rf"[{_WORD}]{{2,}}"
WORDS_BOUND = rf"(?<![{_WORD}])[{_LETTER}]{{2,}}(?![{_WORD}])"
WORDS_SPLIT = r"(?i)[a-z_]{2,16}"
WORDS_DEPLOYED = rf"(?<![{_WORD}])[{_LETTER}]{{2,16}}(?![{_WORD}])"
SPACE = r"\S+"
WORD_PUNCT = rf"(?U)[{_WORD}]+|[^{_WORD}\s\x1c-\x1f]+"


def tokens(c: Column | str, pattern: str = WORDS_SPLIT) -> Column:
    """All matches in order; null for null. ``WORDS_SPLIT`` cuts words of more than 16 letters, the bounded ones drop them."""
    return F.regexp_extract_all(c, F.lit(pattern), 0)


def distinct_ratio(c: Column) -> Column:
    """Distinct characters of a token by its length."""
    return F.size(F.array_distinct(F.split(c, ""))) / F.length(c)


def drop_repetitive(c: Column, least: float = 0.375) -> Column:
    """Tokens whose share of distinct characters is at least ``least``, in order, repeats kept."""
    return F.filter(c, lambda t: distinct_ratio(t) >= least)


def drop_stopwords(c: Column, words: frozenset[str] | set[str] = STOPWORDS) -> Column:
    """Tokens that aren't in the list, in order, repeats kept."""
    stop = F.array(*[F.lit(w) for w in sorted(words)])
    return F.filter(c, lambda t: ~F.array_contains(stop, t))


def with_stopwords(base: set[str] | frozenset[str], more: list[str], pattern: str = r"[a-z_]{2,16}") -> set[str]:
    """The union of two lists, each word cut as the corpus is."""
    import re

    return set(re.findall(pattern, " ".join([*base, *more]).lower()))


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """(term, freq, length, uniq_ratio) of a column of token lists."""
    counts = df.select(F.explode(column).alias("term")).groupBy("term").agg(F.count("*").alias("freq"))
    return counts.select("term", "freq", F.length("term").cast("bigint").alias("length"), F.round(distinct_ratio(F.col("term")), 6).alias("uniq_ratio"))
