"""The language of a text by its script and, among Latin ones, by its function words, with a cache of known answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage, spread

#: Common function words by language.
PROFILES = {
    "en": "the of and to in is it for with on that this are as at be or from by an has have its not you your we our they was were will can all more when which but up out no so than after into any their one each".split(),
    "de": "der die das und ist in zu den mit für auf von ein eine nicht auch wie nach bei wir man es kann im bleibt sie ich dem des sich aus werden wird oder sind als an zum zur einen einem einer noch nur aber über durch".split(),
    "fr": "le la les et est des une dans pour que qui sur avec pas au du ce sont ne se en après être il nous vous un par plus ou aux cette ces son sa ses leur mais comme elle très sans".split(),
    "es": "el la los las y es en de que una por con para del se su al lo más muy sin sigue ya puede un no como pero sus este esta entre cuando hay ser son también desde todo".split(),
    "it": "il di e che la un per non una sono con del si da nella anche dopo più questo gli ci sta bene alla lo le in al dei delle come ma ha è nel sul della dal molto se tra".split(),
    "pt": "o a os as e de que um uma para com não em do da no na por mais se é muito depois ele fica dos das ao são também como mas sua seu pela pelo ou foi nos nas entre sem até".split(),
    "nl": "de het een en van is dat op te in voor met niet zijn aan ook er maar om bij als naar dan nog wel deze dit door over uit wordt heeft".split(),
    "pl": "i w na z do nie się jest to że o jak po za od przez dla są lub oraz ale przy tego być może które który".split(),
}
#: The scripts that tell a language, in the order in which ties go; the two of Japan are one.
SCRIPTS = {"ru": ("Cyrillic",), "ja": ("Hiragana", "Katakana"), "zh": ("Han",), "th": ("Thai",), "hi": ("Devanagari",), "ar": ("Arabic",), "ko": ("Hangul",), "el": ("Greek",), "he": ("Hebrew",)}
UNKNOWN = "und"


#: All function words, to leave out the others at once.
EVERY = sorted({w for words in PROFILES.values() for w in words})
LONGEST = max(map(len, EVERY))


def _hits(words: str, of: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(sorted(set(of)))))  # Catalyst makes a hash set of it


def detected(df: DataFrame, text: str) -> DataFrame:
    """``df`` with _lang and _hits of a text: by its most frequent script, or by the language with most function words in it.

    Kana make Chinese characters Japanese if there is one for ten of them. Ties go to the first of the scripts, or by
    code. Texts without evidence, null ones too, are ``und`` with 0 hits. All of it is projections, without a shuffle.
    """
    df = df.withColumn("_x", F.coalesce(F.col(text), F.lit("")))
    count = lambda c: F.length("_x") - F.length(F.regexp_replace("_x", c + "+", ""))
    other = F.col("_x").rlike(r"[\u0370-\x{10FFFF}]")  # else there are no letters but Latin ones
    df = df.withColumn("_n", F.when(other, F.struct(*[count("[" + "".join(rf"\p{{Is{s}}}" for s in scripts) + "]").alias(lang) for lang, scripts in SCRIPTS.items()], count(r"\p{IsLatin}").alias("latin"))))
    n = {lang: F.coalesce(F.col(f"_n.{lang}"), F.lit(0)) for lang in SCRIPTS}
    ja = n["ja"] * 10 >= n["zh"]
    n["ja"], n["zh"] = F.when(ja, n["ja"] + n["zh"]).otherwise(0), F.when(ja, 0).otherwise(n["zh"])
    # one of several equal ones: the first of the scripts, and of the languages by code
    df = df.withColumn("_s", F.array_max(F.array(*[F.struct(c.cast("bigint").alias("hits"), F.lit(-i).alias("order"), F.lit(lang).alias("lang")) for i, (lang, c) in enumerate(n.items())])))
    script = (F.col("_s.hits") > 0) & (F.col("_s.hits") >= F.coalesce("_n.latin", F.lit(0)))
    df = df.withColumn("_w", F.when(~script, F.filter(F.split(F.lower("_x"), r"[^\p{L}]+"), lambda w: (F.length(w) <= LONGEST) & w.isin(EVERY))))
    df = df.withColumn("_said", F.array_max(F.array(*[F.struct(_hits("_w", PROFILES[lang]).cast("bigint").alias("hits"), F.lit(-i).alias("order"), F.lit(lang).alias("lang")) for i, lang in enumerate(sorted(PROFILES))])))
    told = F.when(script, F.col("_s")).otherwise(F.col("_said"))
    out = df.withColumn("_lang", F.when(told["hits"] > 0, told["lang"]).otherwise(F.lit(UNKNOWN))).withColumn("_hits", told["hits"])
    return out.drop("_x", "_n", "_s", "_w", "_said")


def detect(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lang, hits) of every row; see ``detected``."""
    told = detected(spread(df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))), "_t")
    return told.select(F.col("_k").alias(key), F.col("_lang").alias("lang"), F.col("_hits").alias("hits"))


def fill_from_cache(df: DataFrame, cache: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lang): the cached language, and a detected one only for keys that the cache doesn't hold."""
    known = df.select(key).join(cache.select(key, "lang").filter(F.col("lang").isNotNull()), key)
    missing = df.join(known.select(key), key, "left_anti")
    return known.select(key, "lang").unionByName(detect(missing, key, text).select(key, "lang"))


def keep_language(df: DataFrame, lang: DataFrame, key: str, wanted: str = "en") -> DataFrame:
    """Rows of ``df`` whose language is ``wanted``.

    The languages are written first: a filter on them would be pushed into the detection, whose columns it would repeat
    in each other's place, so that every word list is read over and over.
    """
    return df.join(cut_lineage(lang.select(key, "lang")).filter(F.col("lang") == wanted).select(key), key, "left_semi")
