"""Column to Column: the string operators. All are built-in expressions and stay in generated code."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The usual named entities in the order in which they are decoded; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&mdash;", "—"), ("&ndash;", "–"), ("&#8211;", "–"), ("&amp;", "&"))
#: Brand values that stand for none; ``generic`` isn't among them.
NULL_BRANDS = ("n/a", "no brand", "none", "not available", "null", "unavailable", "unbranded", "unknown", "learn more", "other", "anonymous")


def chain(c: Column, *steps: Callable[[Column], Column]) -> Column:
    """Steps applied one after another; Catalyst folds them into one projection."""
    return reduce(lambda x, f: f(x), steps, c)


def join_list(c: Column | str, sep: str = " ") -> Column:
    """The elements of a list as one string; null elements are skipped, a null list is null."""
    return F.array_join(c, sep)


def decode_entities(c: Column) -> Column:
    """The usual entities, each once: ``&amp;lt;`` gives ``&lt;``."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)


@F.pandas_udf(T.StringType())
def decode_all_entities(s: pd.Series) -> pd.Series:
    """Every entity of HTML 5; null stays null."""
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) else None)


def strip_tags(c: Column) -> Column:
    """Tags to a space, bodies of scripts and styles with them, then one space for several."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return collapse_space(F.regexp_replace(c, r"<[^>]*>", " "))


def collapse_space(c: Column) -> Column:
    """One space for any white space, none at the ends."""
    return strip_ends(F.regexp_replace(c, r"\s+", " "))


def strip_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without a match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def strip_prefix(c: Column, pattern: str = r"^(by\s+)") -> Column:
    return F.regexp_replace(c, pattern, "")


def strip_brackets(c: Column, greedy: bool = True) -> Column:
    """From the first opening to the last closing brace or parenthesis of a line; not greedy: each pair by itself."""
    return F.regexp_replace(c, r"([{\(].+[\)}])" if greedy else r"([{\(].+?[\)}])", "")


def strip_punct(c: Column, chars: str, by: str = "") -> Column:
    """The given characters deleted, or each changed to ``by``."""
    return F.translate(c, chars, by * len(chars))


def strip_non_word(c: Column) -> Column:
    return collapse_space(F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}_\s]+", ""))


def strip_extra_periods(c: Column) -> Column:
    return F.regexp_replace(c, r"\.(\s*\.)+", ".")


def _accents() -> tuple[str, str]:
    """Latin letters and the plain letter that each decomposes to."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if ord(x) < 128)
        if len(plain) == 1 and plain.isalpha():
            pairs[chr(code)] = plain
    return "".join(pairs), "".join(pairs.values())


def force_ascii(c: Column) -> Column:
    """Accented Latin letters to plain ones, then everything beyond ASCII dropped."""
    a, b = _accents()
    return F.regexp_replace(F.translate(c, a, b), r"[^\x00-\x7F]", "")


@F.pandas_udf(T.StringType())
def force_ascii_full(s: pd.Series) -> pd.Series:
    """The full compatibility decomposition without what is beyond ASCII."""
    return s.map(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode() if isinstance(x, str) else None)


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def null_if_match(c: Column, pattern: str = r"(?i)\Anone\z") -> Column:
    return F.when(c.rlike(pattern), None).otherwise(c)


def not_equal(c: Column, value: str) -> Column:
    """``!=`` that keeps nulls."""
    return ~c.eqNullSafe(F.lit(value))


def update_non_null(c: Column, new: Column) -> Column:
    """``new`` where it isn't null, else ``c``."""
    return F.coalesce(new, c)


def compose_text(title: Column, description: Column, feature: Column, brand: Column) -> Column:
    """The training text; null if any part is."""
    return strip_extra_periods(F.concat(title, F.lit(". "), description, F.lit(". "), feature, F.lit(". "), brand, F.lit(".")))


def compose_query_text(*parts: Column) -> Column:
    """The text at inference: the parts that aren't null."""
    return F.concat_ws(" ", *parts)


def keyword_query(terms: Column) -> Column:
    """Terms as a search: joined words of a phrase are quoted, terms are joined by ``+``."""
    quoted = F.transform(terms, lambda t: F.when(F.contains(t, F.lit("_")), F.concat(F.lit('"'), F.replace(t, F.lit("_"), F.lit(" ")), F.lit('"'))).otherwise(t))
    return F.array_join(quoted, "+")
