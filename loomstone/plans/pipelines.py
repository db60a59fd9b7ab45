"""The whole pipelines: curation, vocabulary, demo table, training and classification."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tokens as K
from ..operators import brand as B
from ..operators import dedupe as D
from ..operators import lemma as L
from ..operators import model as M
from ..operators import phrases as P
from ..operators import prune as R
from ..operators.language_filter import detect, fill_from_cache, keep_language
from ..runtime import cut_lineage


def repair_category(c: Column) -> Column:
    """The label out of an image's alternative text, entities decoded."""
    return X.collapse_space(X.decode_entities(F.coalesce(X.extract(c, r'alt="([^"]+)"'), c)))


def curate(raw: DataFrame, order: str = "row_id", least_category: int = 100, lower: float = 0.5, upper: float = 0.99) -> DataFrame:
    """The clean corpus out of the raw catalogue: (asin, title, brand, description, feature, main_cat, text).

    The order of the stages is part of the meaning: rows without text or label go first, then copies, then the tails
    of the lengths, then small categories; the texts are cleaned, which makes new copies and new tails; brands are
    repaired, categories that became small go, and the text is composed last. Every cut reads its own
    input twice, for the bound and for the rows, so the stages between are written: else the plan would double each time.
    """
    df = raw.select(order, "asin", X.join_list("description").alias("description"), "title", X.join_list("feature").alias("feature"), "brand", "main_cat")
    df = df.withColumns({c: X.null_if_empty(X.collapse_space(F.col(c))) for c in ("description", "title", "brand")})
    df = df.na.drop(subset=["asin", "description", "main_cat", "title"])
    df = D.chain_first_wins(df, [["asin"], ["description"]], order)
    df = cut_lineage(df.withColumn("description", X.strip_tags(F.col("description"))).filter(F.col("description") != ""))
    df = R.trim_quantile(df, {"description": F.length("description")}, lower, upper)
    df = cut_lineage(df.withColumn("main_cat", repair_category(F.col("main_cat"))))
    df = R.prune_small(df, "main_cat", least_category)
    df = cut_lineage(D.chain_first_wins(df, [["title", "brand"]], order))
    df = R.trim_central(df, {"title": F.length("title")}, 0.98)
    cleaned = {c: X.chain(F.col(c), X.decode_entities, F.lower) for c in ("description", "title", "brand")}
    cleaned |= {c: X.strip_tags(cleaned[c]) for c in ("title", "brand")}
    df = df.withColumns({c: X.null_if_empty(X.collapse_space(v)) for c, v in cleaned.items()}).na.drop(subset=["description", "title"])
    df = cut_lineage(D.chain_first_wins(df, [["title", "brand"], ["description"]], order))
    df = cut_lineage(R.trim_quantile(df, {"title": F.length("title"), "description": F.length("description")}, 0.01))
    df = R.trim_quantile(df, {"brand": F.length("brand")}, upper=0.99)
    df = cut_lineage(df.withColumn("brand", B.repair_brand(F.col("brand"))))
    df = cut_lineage(B.gazetteer_fill(df, "brand", "title").na.fill("", ["brand"]))
    df = R.prune_small(df, "main_cat", least_category)
    feature = X.chain(F.coalesce("feature", F.lit("")), F.lower, X.decode_entities, X.strip_tags, X.strip_brackets)
    df = cut_lineage(df.withColumn("feature", feature))
    df = R.trim_iqr(df, F.length("feature"))
    return df.withColumn("text", X.compose_text(F.col("title"), F.col("description"), F.col("feature"), F.col("brand"))).drop(order)


def tokenise(df: DataFrame, text: str = "text") -> DataFrame:
    """``tokens``: plain letters, underscores out, words of 2 to 16 letters, repetitive ones dropped."""
    plain = X.chain(F.col(text), X.force_ascii, F.lower, lambda c: X.strip_punct(c, "_"))
    return df.withColumn("tokens", K.drop_repetitive(K.tokens(plain)))


def vocabulary_stage(clean: DataFrame, cache: DataFrame, key: str = "asin", least: int = 100, least_brand: int = 10) -> DataFrame:
    """(key, main_cat, tokens): English only, lemmas without stopwords, with the phrases joined, the longest first.

    Phrases are the best bigrams of each category and the brands of several words, both as lemmas. Rows of rare brands
    go first. The phrases are a parameter, which goes to the driver: ``least`` and ``least_brand`` bound their number.
    """
    clean = cut_lineage(clean.withColumn("brand", B.brand_token(F.col("brand"))))
    clean = cut_lineage(R.brand_policy(clean, "main_cat", "brand"))
    lang = fill_from_cache(clean.select(key, "text"), cache, key, "text")
    plain = cut_lineage(tokenise(keep_language(clean, lang, key)).select(key, "main_cat", "brand", "tokens"))
    words = cut_lineage(L.vocabulary_words(plain, "tokens"))
    lemmas = L.lemmatise_known(plain, key, "tokens", words)
    df = cut_lineage(plain.drop("tokens").join(lemmas, key).withColumn("tokens", K.drop_stopwords("tokens")))
    best = P.top_half(P.pmi(df, "tokens", "main_cat", least), "main_cat").select(F.array("a", "b").alias("phrase"))
    named = P.brand_phrases(df, "brand", sorted(K.STOPWORDS), least_brand).withColumn("name", F.array_join("phrase", "_"))
    brands = L.lemmatise_known(named, "name", "phrase", words).select("phrase")
    phrases = [tuple(r["phrase"]) for r in best.unionByName(brands).distinct().collect()]
    return df.select(key, "main_cat").join(P.mwe_join_any(df, key, "tokens", phrases), key)


#: Fixed value: the notice that the shop puts into descriptions.
CAVEAT = "We aim to show you accurate product information. Manufacturers, suppliers and others provide what you see here, and we have not verified it. See our disclaimer"


def demo_table(retail: DataFrame, least: int = 10, keep_lang: bool = True, lower: float = 0.5, upper: float = 0.99) -> DataFrame:
    """The demo table out of a retail listing: copies by (title, brand), then by description, placeholders to null,
    rows with a null dropped, the main category out of the path, lengths trimmed, only descriptions in English kept, by
    detection and not by the given label, small categories dropped."""
    df = D.chain_first_wins(retail, [["title", "brand"], ["description"]], "item_id")
    df = df.withColumns({c: X.null_if_match(F.col(c)) for c in ("title", "category", "description", "brand")})
    df = df.na.drop(subset=["title", "category", "description", "brand"])
    df = df.withColumn("main_cat", X.extract(F.col("category"), r"^([\w\s&]+)\s\|"))
    df = df.filter(X.not_equal(F.col("main_cat"), "Shop by Brand"))
    df = df.withColumn("description", X.strip_ends(F.replace(X.strip_punct(F.col("description"), "|"), F.lit(CAVEAT), F.lit(""))))
    df = df.withColumn("n_char", (F.length("title") + F.length("category") + F.length("description")).cast("bigint"))
    df = df.withColumn("category", X.strip_ends(F.replace(X.strip_punct(F.col("category"), "|", " "), F.lit("  "), F.lit(" "))))
    df = cut_lineage(R.trim_quantile(cut_lineage(df), {"n_char": F.col("n_char")}, lower, upper))
    df = df.drop("lang").join(detect(df, "item_id", "description").filter(F.col("lang") == "en").select("item_id", "lang"), "item_id")
    df = R.prune_small(df.select(*[c for c in retail.columns if c in df.columns], *[c for c in df.columns if c not in retail.columns]), "main_cat", least + 1)
    return df if keep_lang else df.drop("lang")


def train(df: DataFrame, **kw) -> PipelineModel:
    """A balanced one-vs-rest model of (text, label)."""
    return M.linear(**kw).fit(M.with_weights(df, "label"))


def classify(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``predicted`` beside each row of (text); no label is needed."""
    head = PipelineModel([s for s in model.stages if type(s).__name__ != "StringIndexerModel"])
    names = next(s for s in model.stages if type(s).__name__ == "StringIndexerModel").labels
    return head.transform(df).withColumn("predicted", F.element_at(F.array(*[F.lit(x) for x in names]), F.col("prediction").cast("int") + 1))
