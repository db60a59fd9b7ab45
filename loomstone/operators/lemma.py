"""Lemmas by detachment rules that a vocabulary must confirm, told apart by part of speech, and by dictionaries.

A form comes to a base only if the base is itself a word of the vocabulary, so that ``string`` isn't the participle of
``str`` nor ``series`` a plural. Whether a form is read as a verb or as a noun is told by the word before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut_lineage, spread

#: Irregular English verbs, by base: past and participle.
VERBS = {
    "be": "is are was were been am being", "have": "has had having", "do": "does did done doing", "go": "goes went gone", "make": "made", "buy": "bought", "keep": "kept", "hold": "held", "leave": "left", "sell": "sold", "tell": "told", "come": "came", "give": "gave given",
    "take": "took taken", "write": "wrote written", "see": "saw seen", "know": "knew known", "think": "thought", "get": "got gotten", "find": "found", "say": "said", "feel": "felt", "bring": "brought", "begin": "began begun", "run": "ran", "build": "built", "send": "sent", "spend": "spent",
    "lose": "lost", "mean": "meant", "meet": "met", "pay": "paid", "sit": "sat", "stand": "stood", "speak": "spoke spoken", "break": "broke broken", "choose": "chose chosen", "wear": "wore worn", "tear": "tore torn", "drive": "drove driven", "ride": "rode ridden", "eat": "ate eaten", "fall": "fell fallen",
    "grow": "grew grown", "show": "shown", "throw": "threw thrown", "draw": "drew drawn", "fly": "flew flown", "freeze": "froze frozen", "hide": "hid hidden", "teach": "taught", "catch": "caught", "fight": "fought", "sleep": "slept", "wind": "wound", "hang": "hung", "shake": "shook shaken", "swim": "swam swum",
    "sing": "sang sung", "ring": "rang rung", "drink": "drank drunk", "rise": "rose risen", "lie": "lay lain lying", "lay": "laid", "lead": "led", "feed": "fed", "win": "won", "shine": "shone", "weave": "wove woven", "sew": "sewn", "bend": "bent", "lend": "lent", "shoot": "shot", "stick": "stuck", "die": "dying", "tie": "tying",
}
#: Irregular plurals, by base.
NOUNS = {"man": "men", "woman": "women", "child": "children", "foot": "feet", "tooth": "teeth", "mouse": "mice", "goose": "geese", "knife": "knives", "leaf": "leaves", "shelf": "shelves", "wife": "wives", "life": "lives", "half": "halves", "wolf": "wolves", "loaf": "loaves", "scarf": "scarves", "person": "people", "ox": "oxen", "die": "dice", "index": "indices", "axis": "axes", "basis": "bases"}
#: Comparatives that no rule leads back.
ADJECTIVES = {"good": "better best", "bad": "worse worst", "far": "further furthest"}
#: Words that look like a form and are none.
WHOLE = frozenset("during ceiling string spring thing king ring wing sling swing morning evening nothing something anything everything wedding pudding bedding clothing lighting railing sibling darling sterling herring speed need feed seed weed breed bleed hundred sacred naked wicked kindred series species news lens gas bus plus glass glasses always perhaps its this his us as is was yes thus various famous previous serious across less unless process access address business press class cross dress grass mass pass toss canvas atlas iris tennis chess".split())
#: Words before a verb, and words before a noun.
BEFORE_VERB = frozenset("to will can could would should may might must not is are was were be been being i you we they who don doesn didn do does did".split())
BEFORE_NOUN = frozenset("the a an this that these those my your his her its our their each every no some any of in for with by".split())
IRREGULAR_VERBS = {form: base for base, forms in VERBS.items() for form in forms.split()}
IRREGULAR = {form: base for table in (VERBS, NOUNS, ADJECTIVES) for base, forms in table.items() for form in forms.split()} | {"left": "leave", "lives": "life", "leaves": "leaf"}


def noun_bases(word: str) -> list[str]:
    """What a plural may be the plural of, the likeliest first."""
    if len(word) < 4 or not word.endswith("s") or word.endswith(("ss", "us", "is")):
        return []
    out = [word[:-3] + "y"] if word.endswith("ies") and len(word) > 4 else []
    if word.endswith(("sses", "shes", "ches", "xes", "zes", "oes")):
        out.append(word[:-2])
    return [*out, word[:-1]]


def verb_bases(word: str) -> list[str]:
    """What an inflected verb may come from, the likeliest first."""
    for end in ("ing", "ed"):
        stem = word[: -len(end)]
        if word.endswith(end) and len(stem) > 1 and any(c in "aeiouy" for c in stem):
            out = [stem[:-1] + "y"] if end == "ed" and stem.endswith("i") else []
            if stem[-1] == stem[-2] and stem[-1] not in "aeiou":
                out += [stem, stem[:-1]] if stem[-1] in "lsz" else [stem[:-1], stem]
                return out
            short = stem[-1] not in "aeiouwxy" and stem[-2] in "aeiou" and (len(stem) == 2 or stem[-3] not in "aeiou")
            silent = stem.endswith(("at", "iz", "bl", "v", "c", "s", "u", "rg", "dg")) or short and len(stem) <= 4
            return [*out, stem + "e", stem] if silent else [*out, stem, stem + "e"]
    return noun_bases(word)


def fixed(word: str, pos: str | None) -> str | None:
    """The lemma that the lists give, whatever the vocabulary; null if they don't tell."""
    if pos == "v" and word in IRREGULAR_VERBS:
        return IRREGULAR_VERBS[word]
    if word in IRREGULAR and not (pos == "n" and word in IRREGULAR_VERBS):
        return IRREGULAR[word]
    return word if word in WHOLE else None


def lemma(word: str, known: set[str] | frozenset[str] | dict | tuple | None = None, pos: str | None = None) -> str:
    """The base of a word; ``pos`` is ``n`` or ``v`` where the word before tells it.

    With ``known`` words the base of a verb must be one of them; a plural without a known base loses its ending. Without
    ``known`` it is the likeliest base.
    """
    if (told := fixed(word, pos)) is not None:
        return told
    bases = noun_bases(word) if pos == "n" else verb_bases(word)
    for base in bases:
        if known is None or base in known:
            return base
    return next(iter(noun_bases(word)), word)


def part_of_speech(before: str | None) -> str | None:
    return "v" if before in BEFORE_VERB else "n" if before in BEFORE_NOUN else None


def _lemmas(row: list[str], memo: dict) -> list[str]:
    out, before = [], None
    for t in row:
        at = (t, part_of_speech(before))
        if at not in memo:
            memo[at] = lemma(t, None, at[1])
        out.append(memo[at])
        before = t
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def lemmatise(tokens: pd.Series) -> pd.Series:
    """Each token's lemma by rules alone, in order; null for null."""
    memo: dict = {}
    return tokens.map(lambda row: None if row is None else _lemmas(list(row), memo))


def vocabulary_words(df: DataFrame, tokens: str, least: int = 2) -> DataFrame:
    """(form, n): words of ``least`` occurrences or more that have the letters of English and may confirm a base."""
    return df.select(F.explode(tokens).alias("form")).filter(F.col("form").rlike("^[a-z]{2,}$")).groupBy("form").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


#: Readings of a word, in the order of the columns of ``readings``.
READINGS = (None, "n", "v")
_READING = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("i", T.IntegerType()), T.StructField("lemma", T.StringType()), T.StructField("sure", T.BooleanType())])


def _candidates(word: str) -> list[tuple[int, int, str, bool]]:
    """(reading, rank, lemma, needs no confirmation) of all that ``lemma`` may make of a word, in their order."""
    out = []
    for at, pos in enumerate(READINGS):
        if (told := fixed(word, pos)) is not None:
            out.append((at, 0, told, True))
        elif bases := noun_bases(word) if pos == "n" else verb_bases(word):
            out += [(at, i, base, False) for i, base in enumerate(bases)] + [(at, len(bases), lemma(word, (), pos), True)]
    return out


@F.pandas_udf(T.ArrayType(_READING))
def _readings(forms: pd.Series) -> pd.Series:
    return forms.map(_candidates)


def _may_change(form: Column) -> Column:
    return form.endswith("s") | form.endswith("ed") | form.endswith("ing") | form.isin(sorted(IRREGULAR.keys() | IRREGULAR_VERBS.keys()))


def readings(df: DataFrame, tokens: str, words: DataFrame) -> DataFrame:
    """(form, base, noun, verb): the lemmas of the words of ``df`` that have another one than themselves in any reading."""
    forms = df.select(F.explode(tokens).alias("form")).filter(_may_change(F.col("form"))).distinct()
    every = forms.select("form", F.explode(_readings("form")).alias("_r")).select("form", "_r.*")
    known = words.select(F.col("form").alias("lemma")).distinct().withColumn("known", F.lit(True))
    told = every.join(known, "lemma", "left").filter(F.col("sure") | F.col("known"))
    of = [F.min_by(F.when(F.col("at") == at, F.col("lemma")), F.when(F.col("at") == at, F.col("i"))) for at in range(len(READINGS))]
    told = told.groupBy("form").agg(*[c.alias(name) for c, name in zip(of, ("base", "noun", "verb"), strict=True)])
    told = told.select("form", *[F.coalesce(name, "form").alias(name) for name in ("base", "noun", "verb")])
    return told.filter((F.col("base") != F.col("form")) | (F.col("noun") != F.col("form")) | (F.col("verb") != F.col("form")))


def lemmatise_known(df: DataFrame, key: str, tokens: str, words: DataFrame, most: int | None = None, sent: int = 1_000_000) -> DataFrame:
    """(key, tokens): lemmas that the vocabulary ``words`` (form) confirms; null stays null.

    Each word that isn't its own lemma is read once, for any vocabulary. Up to ``sent`` such words go to the tasks, more
    are met by a join of forms, with the same result. A caller that gives ``most`` asks for ``dictionary``, which reads
    each word by its likeliest part of speech, where the vocabulary is longer than that.
    """
    if most is not None and (forms := cut_lineage(words.select("form").distinct())).count() > most:
        return lemmatise_by(df, key, tokens, dictionary(forms))
    table = cut_lineage(readings(df, tokens, words))  # counted and read
    if table.count() > sent:
        return _lemmatise_joined(df, key, tokens, table)
    known = df.sparkSession.sparkContext.broadcast({r[0]: tuple(r[1:]) for r in table.toLocalIterator()})
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = known.value.get
        at = dict.fromkeys(BEFORE_VERB, 2) | dict.fromkeys(BEFORE_NOUN - BEFORE_VERB, 1)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            for row in rows:
                before = None
                for i, t in enumerate(row or ()):
                    if (told := read(t)) is not None:
                        row[i] = told[at.get(before, 0)]
                    before = t
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.string()))], names=[key, tokens])

    return spread(df.select(key, tokens)).mapInArrow(run, f"`{key}` {kind}, `{tokens}` array<string>")


def _lemmatise_joined(df: DataFrame, key: str, tokens: str, table: DataFrame) -> DataFrame:
    """The same by a join; the rows are numbered first, so that equal or null keys stay apart."""
    rows = cut_lineage(df.select(key, tokens).withColumn("_row", F.monotonically_increasing_id()))
    t = F.col(tokens)
    pairs = F.transform(t, lambda x, i: F.struct(i.alias("i"), x.alias("form"), F.when(i > 0, F.get(t, i - 1)).alias("before")))
    placed = rows.select("_row", F.explode(pairs).alias("_p")).select("_row", "_p.*")
    verb, noun = F.col("before").isin(sorted(BEFORE_VERB)), F.col("before").isin(sorted(BEFORE_NOUN))
    found = F.coalesce(F.when(verb, F.col("verb")).when(noun, F.col("noun")).otherwise(F.col("base")), F.col("form"))
    read = placed.join(table, "form", "left").select("_row", "i", found.alias("t")).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("_t"))
    return rows.join(read, "_row", "left").select(key, F.coalesce(F.transform("_t", lambda x: x["t"]), t).alias(tokens))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _bases(forms: pd.Series) -> pd.Series:
    return forms.map(lambda w: [IRREGULAR[w]] if w in IRREGULAR else [] if w in WHOLE else verb_bases(w))


def dictionary(forms: DataFrame) -> DataFrame:
    """(form, lemma) of a vocabulary (form) of any size: each form with its first base that is a form as well."""
    every = forms.select("form", F.posexplode(_bases("form")).alias("i", "lemma"))
    return every.join(forms.select(F.col("form").alias("lemma")), "lemma", "left_semi").groupBy("form").agg(F.min_by("lemma", "i").alias("lemma"))


def lemmatise_by(df: DataFrame, key: str, tokens: str, dictionary: DataFrame) -> DataFrame:
    """(key, tokens) by a table (form, lemma) of any size, through an equality join; unknown forms and empty rows stay."""
    placed = df.select(key, F.posexplode_outer(tokens).alias("i", "form"))
    found: Column = F.coalesce(F.col("lemma"), F.col("form"))
    out = placed.join(dictionary.select("form", "lemma"), "form", "left").select(key, "i", found.alias("t"))
    words = F.filter(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"].isNotNull())
    return out.groupBy(key).agg(F.transform(words, lambda x: x["t"]).alias(tokens))
