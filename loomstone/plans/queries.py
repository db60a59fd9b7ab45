"""The queries of the core operators over the project's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import tokens as K
from ..operators import brand as B
from ..operators import dedupe as D
from ..operators import evaluate as E
from ..operators import explain as W
from ..operators import lemma as L
from ..operators import model as M
from ..operators import phrases as P
from ..operators import profile as S
from ..operators import prune as R
from ..operators import sampling as A
from ..operators import vectorize as V
from ..operators.sgd import Sgd
from ..operators.language_filter import PROFILES, SCRIPTS, UNKNOWN, detect, fill_from_cache, keep_language
from ..runtime import cut_lineage, scratch_path, table
from ..schemas import RAW
from ..sources import io
from . import pipelines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Bounds of frequencies for these tables.
LEAST_BIGRAM, LEAST_BRAND, LEAST_CATEGORY = 10, 5, 20


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def amazon(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "amazon_raw")


def walmart(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "walmart")


def documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def written(s: SparkSession, d: str) -> DataFrame:
    """Documents with any character that isn't white space."""
    return documents(s, d).filter(F.col("text").rlike(r"\S"))


_WRITTEN = r"SELECT * FROM documents WHERE regexp_matches(text, '\S')"
_DESC = "array_to_string(description, ' ')"


# --- copies, nulls and filters


@query(
    rf"""WITH d AS ({_WRITTEN}), f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1),
    q AS (SELECT quantile_cont(length(text), 0.5) AS lo, quantile_cont(length(text), 0.99) AS hi FROM f)
    SELECT source, count(*) AS n FROM f, q WHERE length(text) BETWEEN lo AND hi GROUP BY source"""
)
def curated_source_counts(s, d):
    first = D.first_wins(written(s, d).select("doc_id", "text", "source"), ["text"], "doc_id")
    return S.value_counts(R.trim_quantile(first, {"text": F.length("text")}, 0.5, 0.99), "source")


@query("SELECT row_id, asin, title, brand FROM amazon_raw QUALIFY row_number() OVER (PARTITION BY asin ORDER BY row_id) = 1")
def dedupe_first_wins(s, d):
    return D.first_wins(amazon(s, d).select("row_id", "asin", "title", "brand"), ["asin"], "row_id")


@query(
    f"""WITH a AS (SELECT *, {_DESC} AS x FROM amazon_raw QUALIFY row_number() OVER (PARTITION BY asin ORDER BY row_id) = 1),
    b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY x ORDER BY row_id) = 1),
    c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY title, brand ORDER BY row_id) = 1) SELECT row_id, asin FROM c"""
)
def dedupe_chain(s, d):
    df = amazon(s, d).select("row_id", "asin", X.join_list("description").alias("x"), "title", "brand")
    return D.chain_first_wins(df, [["asin"], ["x"], ["title", "brand"]], "row_id").select("row_id", "asin")


@query("SELECT count(*) AS n_rows, count(DISTINCT asin) AS n_distinct, count(*) - count(DISTINCT asin) AS n_duplicates FROM amazon_raw")
def duplicate_probe(s, d):
    return D.duplicate_probe(amazon(s, d), ["asin"])


@query("SELECT DISTINCT lower(brand) AS brand FROM amazon_raw WHERE brand IS NOT NULL")
def distinct_brands(s, d):
    return amazon(s, d).filter(F.col("brand").isNotNull()).select(F.lower("brand").alias("brand")).distinct()


@query(
    """SELECT sum((title IS NULL)::INT)::BIGINT AS title, sum((brand IS NULL)::INT)::BIGINT AS brand, sum((description IS NULL)::INT)::BIGINT AS description,
    sum((main_cat IS NULL)::INT)::BIGINT AS main_cat, bool_or(asin IS NULL) AS any_asin FROM amazon_raw"""
)
def null_probe(s, d):
    n = lambda c: F.sum(F.col(c).isNull().cast("bigint")).alias(c)
    return amazon(s, d).agg(n("title"), n("brand"), n("description"), n("main_cat"), F.bool_or(F.col("asin").isNull()).alias("any_asin"))


_NULLS = ", ".join(f"'{b}'" for b in X.NULL_BRANDS)


@query(f"SELECT row_id, brand, main_cat FROM amazon_raw WHERE main_cat IS DISTINCT FROM 'Kitchen & Table' AND lower(brand) IN ({_NULLS})")
def filter_isin_nullsafe_ne(s, d):
    return amazon(s, d).filter(X.not_equal(F.col("main_cat"), "Kitchen & Table") & F.lower("brand").isin(*X.NULL_BRANDS)).select("row_id", "brand", "main_cat")


@query(r"SELECT row_id, brand FROM amazon_raw WHERE starts_with(brand, 'by ') OR regexp_matches(brand, '^(Visit|Brand)') OR contains(brand, 'Works') OR regexp_matches(brand, '^\s*$')")
def filter_prefix_regex(s, d):
    b = F.col("brand")
    return amazon(s, d).filter(b.startswith("by ") | b.rlike("^(Visit|Brand)") | b.contains("Works") | b.rlike(r"\A\s*\z")).select("row_id", "brand")


@query("SELECT row_id, length(title) AS n_title, len(feature) AS n_feature FROM amazon_raw WHERE length(title) > 60 AND len(feature) > 1")
def filter_lengths(s, d):
    n, k = F.length("title").cast("bigint"), F.size("feature").cast("bigint")
    return amazon(s, d).select("row_id", n.alias("n_title"), k.alias("n_feature")).filter((F.col("n_title") > 60) & (F.col("n_feature") > 1))


@query(r"SELECT t AS token, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '\s+')) AS t FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(t, '^[\p{N}]+$') GROUP BY t")
def numeric_tokens(s, d):
    t = documents(s, d).filter(F.col("text").isNotNull()).select(F.explode(F.split("text", r"\s+")).alias("token"))
    return t.filter(F.col("token").rlike(r"\A\p{N}+\z")).groupBy("token").agg(F.count("*").alias("n"))


@query("SELECT item_id, title, description, brand, lang FROM walmart WHERE title IS NOT NULL AND description IS NOT NULL AND brand IS NOT NULL AND lang IS NOT NULL")
def dropna_any(s, d):
    return walmart(s, d).select("item_id", "title", "description", "brand", "lang").na.drop("any")


@query("SELECT item_id, nullif(description, '') AS description, nullif(brand, '') AS brand, nullif(lang, '') AS lang FROM walmart")
def nullif_empty(s, d):
    return walmart(s, d).select("item_id", *[X.null_if_empty(F.col(c)).alias(c) for c in ("description", "brand", "lang")])


@query("SELECT row_id, CASE WHEN regexp_matches(brand, '(?i)^none$') THEN NULL ELSE brand END AS brand FROM amazon_raw")
def regex_to_null(s, d):
    return amazon(s, d).select("row_id", X.null_if_match(F.col("brand")).alias("brand"))


_REPAIRED = rf"""SELECT row_id, title, coalesce(CASE WHEN regexp_matches(b, '^visit (?:the|amazon''s) (.+) (?:store|page)$') THEN regexp_extract(b, '^visit (?:the|amazon''s) (.+) (?:store|page)$', 1) END, b) AS brand FROM (
    SELECT row_id, title, regexp_replace(CASE WHEN b IN ({_NULLS}) THEN NULL ELSE b END, '^(by\s+)', '') AS b FROM (
        SELECT row_id, title, regexp_replace(regexp_replace(lower(brand), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS b FROM amazon_raw))"""


@query(f"SELECT row_id, brand FROM ({_REPAIRED})")
def masked_update(s, d):
    return amazon(s, d).select("row_id", B.repair_brand(F.col("brand")).alias("brand"))


@query("SELECT item_id, coalesce(nullif(lang, ''), CASE WHEN starts_with(description, 'Das ') THEN 'de' END, lang) AS lang FROM walmart")
def update_nonnull(s, d):
    guess = F.coalesce(X.null_if_empty(F.col("lang")), F.when(F.col("description").startswith("Das "), "de"))
    return walmart(s, d).select("item_id", X.update_non_null(F.col("lang"), guess).alias("lang"))


# --- text


@query(
    rf"""SELECT row_id, regexp_replace(title || '. ' || {_DESC} || '. ' || coalesce(array_to_string(feature, ' '), '') || '. ' || brand || '.', '\.(\s*\.)+', '.', 'g') AS text FROM amazon_raw"""
)
def compose_text(s, d):
    parts = F.col("title"), X.join_list("description"), F.coalesce(X.join_list("feature"), F.lit("")), F.col("brand")
    return amazon(s, d).select("row_id", X.compose_text(*parts).alias("text"))


@query("SELECT item_id, concat_ws(' ', title, description, category, brand) AS text FROM walmart")
def compose_infer_text(s, d):
    return walmart(s, d).select("item_id", X.compose_query_text(*[F.col(c) for c in ("title", "description", "category", "brand")]).alias("text"))


def _entities(c: str) -> str:
    for a, b in X.ENTITIES:
        c = f"replace({c}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return c


@query(f"SELECT row_id, {_entities('main_cat')} AS main_cat, {_entities('title')} AS title FROM amazon_raw")
def decode_entities(s, d):
    return amazon(s, d).select("row_id", X.decode_entities(F.col("main_cat")).alias("main_cat"), X.decode_entities(F.col("title")).alias("title"))


_SPACE = r"regexp_replace(regexp_replace({}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_TAGS = _SPACE.format("regexp_replace(regexp_replace({}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g')")


@query(f"SELECT row_id, {_TAGS.format(_DESC)} AS description FROM amazon_raw")
def strip_tags(s, d):
    return amazon(s, d).select("row_id", X.strip_tags(X.join_list("description")).alias("description"))


@query("""SELECT row_id, CASE WHEN regexp_matches(main_cat, 'alt="([^"]+)"') THEN regexp_extract(main_cat, 'alt="([^"]+)"', 1) END AS label FROM amazon_raw""")
def regex_extract_null(s, d):
    return amazon(s, d).select("row_id", X.extract(F.col("main_cat"), r'alt="([^"]+)"').alias("label"))


@query(r"SELECT item_id, CASE WHEN regexp_matches(category, '^([\w\s&]+)\s\|') THEN regexp_extract(category, '^([\w\s&]+)\s\|', 1) END AS main_cat FROM walmart")
def category_from_path(s, d):
    return walmart(s, d).select("item_id", X.extract(F.col("category"), r"^([\w\s&]+)\s\|").alias("main_cat"))


@query(r"SELECT item_id, regexp_replace(brand, '^(by\s+)', '') AS brand, regexp_replace(description, '([{\(].+[\)}])', '', 'g') AS description, replace(category, ' | ', ' / ') AS category FROM walmart")
def strip_prefix_and_brackets(s, d):
    return walmart(s, d).select("item_id", X.strip_prefix(F.col("brand")).alias("brand"), X.strip_brackets(F.col("description")).alias("description"), F.replace("category", F.lit(" | "), F.lit(" / ")).alias("category"))


@query(rf"SELECT doc_id, {_SPACE.format('text')} AS text FROM documents")
def whitespace_normalise(s, d):
    return documents(s, d).select("doc_id", X.collapse_space(F.col("text")).alias("text"))


@query(r"SELECT doc_id, translate(text, '|_.,', '') AS bare, regexp_replace(text, '\.(\s*\.)+', '.', 'g') AS periods FROM documents")
def strip_punct(s, d):
    return documents(s, d).select("doc_id", X.strip_punct(F.col("text"), "|_.,").alias("bare"), X.strip_extra_periods(F.col("text")).alias("periods"))


_A, _B = X._accents()
_ASCII = rf"regexp_replace(translate({{}}, '{_A}', '{_B}'), '[^\x00-\x7F]', '', 'g')"


@query(rf"SELECT doc_id, {_ASCII.format('text')} AS text FROM documents")
def ascii_fold(s, d):
    return documents(s, d).select("doc_id", X.force_ascii(F.col("text")).alias("text"))


@query("SELECT doc_id, " + _SPACE.format(r"regexp_replace(text, '[^\p{L}\p{M}\p{N}_\s]+', '', 'g')") + " AS text FROM documents")
def strip_non_word(s, d):
    return documents(s, d).select("doc_id", X.strip_non_word(F.col("text")).alias("text"))


@query(f"SELECT row_id, {_DESC} AS text, length({_DESC}) AS n_char, lower(brand) AS brand, len(string_split(brand, ' ')) AS n_words FROM amazon_raw")
def split_join_lengths(s, d):
    text = X.join_list("description")
    return amazon(s, d).select("row_id", text.alias("text"), F.length(text).cast("bigint").alias("n_char"), F.lower("brand").alias("brand"), F.when(F.col("brand").isNotNull(), F.size(F.split("brand", " ", -1)).cast("bigint")).alias("n_words"))


@query("SELECT category_id, array_to_string(list_transform(string_split(lower(main_cat), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM category_list")
def title_case(s, d):
    return table(s, d, "category_list").select("category_id", F.initcap("main_cat").alias("title"))


# --- tokens


def _tokens_sql(pattern: str, source: str, text: str = "text", key: str = "doc_id") -> str:
    return f"SELECT t AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all({text}, '{pattern}')) AS t FROM ({source})) GROUP BY t"


def _token_counts(df: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    return df.select(F.explode(K.tokens(text, pattern)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(_tokens_sql("(?i)[a-z_]{2,16}", _WRITTEN))
def tokenize_corpus(s, d):
    return _token_counts(written(s, d), K.WORDS_SPLIT)


_W = r"\p{L}\p{N}_"
_SPACES = r"\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _bound_sql(most: str) -> str:
    """DuckDB's patterns look neither back nor ahead: whole words first, then those wholly of plain letters."""
    plain = rf"^[A-Za-z_\x{{130}}\x{{131}}\x{{17f}}\x{{212a}}]{{2,{most}}}$"
    return f"SELECT token, n FROM ({_tokens_sql(f'[{_W}]+', _WRITTEN)}) WHERE regexp_matches(token, '{plain}')"


@query(_bound_sql("16"))
def tokenize_bounded(s, d):
    return _token_counts(written(s, d), K.WORDS_DEPLOYED)


@query(_bound_sql(""))
def tokenize_words(s, d):
    return _token_counts(written(s, d), K.WORDS_BOUND)


@query(_tokens_sql(f"[{_W}]{{2,}}", _WRITTEN))
def tokenize_unicode(s, d):
    return _token_counts(written(s, d), K.WORDS_UNICODE)


@query(_tokens_sql(r"\S+", _WRITTEN))
def tokenize_space(s, d):
    return _token_counts(written(s, d), K.SPACE)


@query(_tokens_sql(f"[{_W}]+|[^{_W}{_SPACES}]+", _WRITTEN))
def tokenize_wordpunct(s, d):
    return _token_counts(written(s, d), K.WORD_PUNCT)


_CORPUS = rf"SELECT doc_id, source, lang, regexp_extract_all(lower({_ASCII.format('text')}), '[a-z_]{{2,16}}') AS tokens FROM ({_WRITTEN})"


def corpus(s: SparkSession, d: str) -> DataFrame:
    text = F.lower(X.force_ascii(F.col("text")))
    return written(s, d).select("doc_id", "source", "lang", K.tokens(text, "[a-z_]{2,16}").alias("tokens"))


_RATIO = "len(list_distinct(regexp_extract_all({}, '.')))::DOUBLE / length({})"


@query(f"SELECT term, count(*) AS freq, length(term) AS length, round({_RATIO.format('term', 'term')}, 6) AS uniq_ratio FROM (SELECT unnest(tokens) AS term FROM ({_CORPUS})) GROUP BY term")
def vocab_stats(s, d):
    return K.vocabulary(corpus(s, d), "tokens")


@query(f"SELECT count(DISTINCT t) AS vocabulary FROM (SELECT unnest(tokens) AS t FROM ({_CORPUS}))")
def vocabulary_size(s, d):
    return corpus(s, d).select(F.explode("tokens").alias("t")).agg(F.count_distinct("t").alias("vocabulary"))


@query(f"SELECT doc_id, len(tokens) AS n, len(list_filter(tokens, lambda t: {_RATIO.format('t', 't')} >= 0.375)) AS kept FROM ({_CORPUS})")
def rare_char_tokens(s, d):
    return corpus(s, d).select("doc_id", F.size("tokens").cast("bigint").alias("n"), F.size(K.drop_repetitive(F.col("tokens"))).cast("bigint").alias("kept"))


_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(K.STOPWORDS)) + "]"


@query(f"SELECT doc_id, array_to_string(list_filter(tokens, lambda t: NOT list_contains({_STOP}, t)), ' ') AS text FROM ({_CORPUS})")
def stopword_filter(s, d):
    return corpus(s, d).select("doc_id", F.array_join(K.drop_stopwords("tokens"), " ").alias("text"))


# --- counts and distributions


@query("SELECT main_cat, count(*) AS n FROM amazon_raw WHERE main_cat IS NOT NULL GROUP BY main_cat")
def value_counts(s, d):
    return S.value_counts(amazon(s, d), "main_cat")


@query("SELECT main_cat, brand, n, round(n / sum(n) OVER (PARTITION BY main_cat), 6) AS share FROM (SELECT main_cat, brand, count(*) AS n FROM amazon_raw GROUP BY main_cat, brand)")
def value_share_in_group(s, d):
    return S.share_in_group(amazon(s, d), "main_cat", "brand")


@query("SELECT main_cat, sum((brand IS NULL)::INT)::BIGINT AS n_null, count(*) AS support, round(sum((brand IS NULL)::INT) / count(*), 6) AS null_share FROM amazon_raw GROUP BY main_cat")
def null_fraction_by_group(s, d):
    return S.null_fraction(amazon(s, d), "main_cat", "brand")


@query("SELECT quantile_cont(length(text), 0.5)::DOUBLE AS q50, quantile_cont(length(text), 0.99)::DOUBLE AS q99 FROM documents")
def length_quantiles(s, d):
    n = F.length("text")
    return documents(s, d).agg(F.percentile(n, F.lit(0.5)).alias("q50"), F.percentile(n, F.lit(0.99)).alias("q99"))


@query(
    """SELECT min(length(text)) AS shortest, max(length(text)) AS longest, round(avg(length(text)), 4) AS mean, round(stddev(length(text)), 4) AS deviation,
    quantile_cont(length(text), 0.25)::DOUBLE AS q25, quantile_cont(length(text), 0.5)::DOUBLE AS q50, quantile_cont(length(text), 0.75)::DOUBLE AS q75 FROM documents"""
)
def length_stats(s, d):
    return S.length_stats(documents(s, d), "text")


@query("SELECT floor(log10(n_chars) / 0.1)::BIGINT AS bucket, count(*) AS n FROM documents WHERE n_chars > 0 GROUP BY 1")
def length_histogram(s, d):
    return S.histogram(documents(s, d), "n_chars", 0.1, log=True)


@query("SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM (SELECT quantile_cont(n_chars, 0.25)::DOUBLE AS q1, quantile_cont(n_chars, 0.75)::DOUBLE AS q3 FROM documents)")
def tukey_fences(s, d):
    return S.fences(documents(s, d), "n_chars")


@query("SELECT (SELECT doc_id FROM documents WHERE text IS NOT NULL ORDER BY length(text) DESC, doc_id LIMIT 1) AS longest, (SELECT doc_id FROM documents WHERE text IS NOT NULL ORDER BY length(text), doc_id LIMIT 1) AS shortest")
def longest_shortest(s, d):
    return S.longest_and_shortest(documents(s, d), "doc_id", "text")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", sum(({c} IS NULL)::INT)::BIGINT AS n_null, round(100 * sum(({c} IS NULL)::INT) / count(*), 4) AS null_pct, count(DISTINCT {c}) AS n_distinct FROM walmart"
        for c in ("item_id", "title", "category", "description", "brand", "main_cat", "lang", "n_char")
    )
)
def dq_summary(s, d):
    return S.quality_summary(walmart(s, d))


@query("SELECT n1, n2, round(1 - n2 / n1, 6) AS reduction FROM (SELECT count(*) AS n1, count(DISTINCT asin) AS n2 FROM amazon_raw)")
def size_reduction(s, d):
    df = amazon(s, d).select("asin")
    return S.reduction(df, df.distinct())


@query("SELECT row_id, title FROM amazon_raw WHERE main_cat = 'Books'")
def single_group(s, d):
    return amazon(s, d).filter(F.col("main_cat") == "Books").select("row_id", "title")


# --- trimming and pruning


@query("SELECT doc_id FROM documents, (SELECT quantile_cont(n_chars, 0.5) AS lo, quantile_cont(n_chars, 0.99) AS hi FROM documents) WHERE n_chars IS NULL OR n_chars BETWEEN lo AND hi")
def trim_quantile(s, d):
    return R.trim_quantile(documents(s, d).select("doc_id", "n_chars"), {"n": F.col("n_chars")}, 0.5, 0.99).select("doc_id")


@query("SELECT row_id FROM amazon_raw, (SELECT quantile_cont(length(title), 0.01) AS lo, quantile_cont(length(title), 0.99) AS hi FROM amazon_raw) WHERE title IS NULL OR length(title) BETWEEN lo AND hi")
def trim_central(s, d):
    return R.trim_central(amazon(s, d).select("row_id", "title"), {"t": F.length("title")}, 0.98).select("row_id")


@query("SELECT doc_id FROM documents, (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.75) AS b FROM documents) WHERE n_chars IS NULL OR n_chars BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)")
def trim_iqr(s, d):
    return R.trim_iqr(documents(s, d).select("doc_id", "n_chars"), F.col("n_chars")).select("doc_id")


@query(
    """SELECT item_id FROM walmart, (SELECT quantile_cont(length(title), 0.01) AS a, quantile_cont(length(description), 0.01) AS b FROM walmart)
    WHERE (title IS NULL OR length(title) >= a) AND (description IS NULL OR length(description) >= b)"""
)
def trim_multi(s, d):
    return R.trim_quantile(walmart(s, d).select("item_id", "title", "description"), {"t": F.length("title"), "d": F.length("description")}, 0.01, 1.0).select("item_id")


@query(f"SELECT row_id, brand FROM amazon_raw WHERE brand IN (SELECT brand FROM amazon_raw GROUP BY brand HAVING count(*) >= {LEAST_CATEGORY})")
def prune_small_categories(s, d):
    return R.prune_small(amazon(s, d).select("row_id", "brand"), "brand", LEAST_CATEGORY)


@query(
    """WITH n AS (SELECT main_cat, brand, count(*) AS n FROM amazon_raw WHERE brand IS NOT NULL GROUP BY ALL), q AS (SELECT main_cat, quantile_cont(n, 0.9) AS q FROM n GROUP BY main_cat)
    SELECT row_id, main_cat, brand FROM amazon_raw a WHERE EXISTS (SELECT 1 FROM n, q WHERE n.main_cat IS NOT DISTINCT FROM q.main_cat AND n.n >= q.q AND n.main_cat IS NOT DISTINCT FROM a.main_cat AND n.brand = a.brand)"""
)
def prune_brand_quantile(s, d):
    return R.prune_quantile(amazon(s, d).select("row_id", "main_cat", "brand"), "main_cat", "brand", 0.9)


@query(
    """WITH a AS (SELECT row_id, main_cat, coalesce(brand, 'none') AS brand FROM amazon_raw),
    g AS (SELECT main_cat, count(*) AS n, CASE WHEN avg((brand = 'none')::INT) = 0 THEN 1.0 ELSE avg((brand = 'none')::INT) END AS share FROM a GROUP BY main_cat),
    t AS (SELECT a.*, n, share FROM a JOIN g ON a.main_cat IS NOT DISTINCT FROM g.main_cat),
    l AS (SELECT * FROM t WHERE n > 100 AND NOT (brand = 'none' AND share < 0.95)),
    c AS (SELECT main_cat, brand, count(*) AS k FROM l GROUP BY ALL), q AS (SELECT main_cat, quantile_cont(k, 0.9) AS q FROM c GROUP BY main_cat)
    SELECT row_id, main_cat, brand FROM t WHERE n <= 100
    UNION ALL SELECT l.row_id, l.main_cat, l.brand FROM l, c, q WHERE l.main_cat IS NOT DISTINCT FROM c.main_cat AND l.brand = c.brand AND c.main_cat IS NOT DISTINCT FROM q.main_cat AND c.k >= q.q"""
)
def brand_policy(s, d):
    df = amazon(s, d).select("row_id", "main_cat", F.coalesce("brand", F.lit("none")).alias("brand"))
    return R.brand_policy(df, "main_cat", "brand", exempt=100, q=0.9)


# --- joins


@query("SELECT a.row_id, a.asin, c.lang FROM amazon_raw a JOIN lang_cache c ON a.asin = c.asin")
def inner_join_keys(s, d):
    return amazon(s, d).select("row_id", "asin").join(table(s, d, "lang_cache"), "asin").select("row_id", "asin", "lang")


@query("SELECT doc_id, asin FROM documents WHERE asin IN (SELECT asin FROM amazon_raw)")
def semi_join_keys(s, d):
    return documents(s, d).select("doc_id", "asin").join(amazon(s, d).select("asin"), "asin", "left_semi")


@query("SELECT DISTINCT asin FROM documents WHERE asin IS NOT NULL INTERSECT SELECT asin FROM lang_cache")
def key_intersection(s, d):
    return documents(s, d).select("asin").filter(F.col("asin").isNotNull()).intersect(table(s, d, "lang_cache").select("asin"))


@query("SELECT row_id, n FROM amazon_raw a LEFT JOIN (SELECT main_cat, count(*) AS n FROM walmart GROUP BY main_cat) w USING (main_cat)")
def left_join_counts(s, d):
    return amazon(s, d).select("row_id", "main_cat").join(walmart(s, d).groupBy("main_cat").agg(F.count("*").alias("n")), "main_cat", "left").select("row_id", "n")


def _detect_sql(source: str, key: str, text: str) -> str:
    """Brute force: every word of every text against every list."""
    lists = ", ".join(f"{{'hits': len(list_filter(w, lambda t: list_contains([{', '.join(repr(x) for x in sorted(set(PROFILES[lang])))}], t))), 'o': {-i}, 'lang': '{lang}'}}" for i, lang in enumerate(sorted(PROFILES)))
    count = lambda *scripts: f"len(regexp_extract_all(x, '[{''.join(rf'\p{{{s}}}' for s in scripts)}]'))"
    ja, zh = count(*SCRIPTS["ja"]), count(*SCRIPTS["zh"])
    n = {lang: count(*scripts) for lang, scripts in SCRIPTS.items()}
    n["ja"], n["zh"] = f"CASE WHEN {ja} * 10 >= {zh} THEN {ja} + {zh} ELSE 0 END", f"CASE WHEN {ja} * 10 >= {zh} THEN 0 ELSE {zh} END"
    scripts = ", ".join(f"{{'hits': {c}, 'o': {-i}, 'lang': '{lang}'}}" for i, (lang, c) in enumerate(n.items()))
    return rf"""(SELECT {key}, CASE WHEN t.hits > 0 THEN t.lang ELSE '{UNKNOWN}' END AS lang, t.hits::BIGINT AS hits FROM (
        SELECT {key}, CASE WHEN s.hits > 0 AND s.hits >= {count('Latin')} THEN s ELSE w END AS t FROM (
        SELECT {key}, x, list_max([{scripts}]) AS s, list_max([{lists}]) AS w FROM (
        SELECT {key}, coalesce({text}, '') AS x, string_split_regex(lower(coalesce({text}, '')), '[^\p{{L}}]+') AS w FROM {source}))))"""


@query(f"SELECT * FROM {_detect_sql('documents', 'doc_id', 'text')}")
def detect_language(s, d):
    return detect(documents(s, d), "doc_id", "text")


@query(f"SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM {_detect_sql('documents', 'doc_id', 'text')} WHERE lang = 'en')")
def keep_english(s, d):
    df = documents(s, d)
    return keep_language(df.select("doc_id", "source"), detect(df, "doc_id", "text"), "doc_id")


_FIRST = f"(SELECT asin, {_DESC} AS x FROM amazon_raw QUALIFY row_number() OVER (PARTITION BY asin ORDER BY row_id) = 1)"


@query(
    f"""WITH f AS {_FIRST}, k AS (SELECT f.asin, c.lang FROM f JOIN lang_cache c ON f.asin = c.asin WHERE c.lang IS NOT NULL)
    SELECT * FROM k UNION ALL SELECT f.asin, g.lang FROM f LEFT JOIN {_detect_sql('f', 'asin', 'x')} g USING (asin) WHERE f.asin NOT IN (SELECT asin FROM k)"""
)
def left_fill_cache(s, d):
    df = D.first_wins(amazon(s, d).select("row_id", "asin", X.join_list("description").alias("x")), ["asin"], "row_id")
    return fill_from_cache(df, table(s, d, "lang_cache"), "asin", "x")


@query(
    rf"""WITH r AS ({_REPAIRED}), t AS (SELECT brand, count(*) AS n FROM r WHERE brand IS NOT NULL AND NOT regexp_matches(brand, '\s') AND brand != 'various' AND length(brand) > 3 GROUP BY brand ORDER BY n DESC, brand LIMIT 100),
    m AS (SELECT row_id, t.brand FROM r, t WHERE r.brand IS NULL AND starts_with(lower(r.title), t.brand) AND NOT regexp_matches(substr(lower(r.title), length(t.brand) + 1, 1), '[\p{{L}}\p{{N}}_]') QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY n DESC, t.brand) = 1)
    SELECT r.row_id, coalesce(r.brand, m.brand) AS brand FROM r LEFT JOIN m USING (row_id)"""
)
def gazetteer_fill(s, d):
    df = amazon(s, d).select("row_id", "title", B.repair_brand(F.col("brand")).alias("brand"))
    return B.gazetteer_fill(df, "brand", "title").select("row_id", "brand")


# --- order, top rows and samples


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 20")
def topk_longest(s, d):
    return documents(s, d).select("doc_id", "n_chars").orderBy(F.desc_nulls_last("n_chars"), "doc_id").limit(20)


@query('SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS "rank" FROM documents QUALIFY "rank" <= 3')
def topk_per_group(s, d):
    return A.top_per_group(documents(s, d).select("source", "doc_id", "n_chars"), "source", [F.desc_nulls_last("n_chars"), F.col("doc_id")], 3).select("source", "doc_id", "rank")


@query("SELECT doc_id FROM documents ORDER BY md5('7' || doc_id::VARCHAR), doc_id LIMIT 100")
def sample_fixed(s, d):
    return A.sample_fixed(documents(s, d).select("doc_id"), "doc_id", 100, "7")


@query("SELECT main_cat, row_id FROM amazon_raw WHERE main_cat IS NOT NULL QUALIFY row_number() OVER (PARTITION BY main_cat ORDER BY md5('3' || row_id::VARCHAR), row_id) = 1")
def random_in_group(s, d):
    return A.one_per_group(amazon(s, d), "main_cat", "row_id", "3")


@query(
    """SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('49' || doc_id::VARCHAR), doc_id) <= round(0.75 * count(*) OVER (PARTITION BY source)) AS is_train FROM documents"""
)
def stratified_split(s, d):
    return A.stratified_split(documents(s, d).select("doc_id", "source"), "doc_id", "source")


# --- phrases

_BIGRAMS = f"SELECT doc_id, lang, tokens[i] AS a, tokens[i + 1] AS b FROM (SELECT *, unnest(range(1, len(tokens))) AS i FROM ({_CORPUS}) WHERE len(tokens) > 1)"


@query(f"SELECT a, b, count(*) AS n FROM ({_BIGRAMS}) GROUP BY a, b HAVING count(*) >= {LEAST_BIGRAM}")
def bigram_counts(s, d):
    return P.bigrams(corpus(s, d), "tokens", []).groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_BIGRAM)


_PMI = f"""SELECT * FROM (WITH c AS ({_CORPUS}), w AS (SELECT lang, t, count(*) AS n FROM (SELECT lang, unnest(tokens) AS t FROM c WHERE lang IS NOT NULL) GROUP BY ALL), tot AS (SELECT lang, sum(n) AS total FROM w GROUP BY lang),
    p AS (SELECT lang, a, b, count(*) AS n FROM ({_BIGRAMS}) WHERE lang IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST_BIGRAM})
    SELECT p.lang, p.a, p.b, p.n, round(log2(p.n * tot.total / (x.n * y.n)), 6) AS pmi FROM p JOIN w x ON x.lang = p.lang AND x.t = p.a JOIN w y ON y.lang = p.lang AND y.t = p.b JOIN tot ON tot.lang = p.lang)"""


def _pmi(s: SparkSession, d: str) -> DataFrame:
    return P.pmi(corpus(s, d).filter(F.col("lang").isNotNull()), "tokens", "lang", LEAST_BIGRAM)


@query(_PMI)
def pmi_bigrams(s, d):
    return _pmi(s, d)


_HALF = f"SELECT lang, a, b, n, pmi FROM (SELECT *, percent_rank() OVER (PARTITION BY lang ORDER BY pmi) AS r FROM ({_PMI})) WHERE r >= 0.5"


@query(_HALF)
def pmi_top_half(s, d):
    return P.top_half(_pmi(s, d), "lang")


@query(
    f"""WITH ph AS (SELECT DISTINCT a, b FROM ({_HALF})), c AS ({_CORPUS}),
    w AS (SELECT doc_id, i, tokens[i] AS t, CASE WHEN i < len(tokens) THEN tokens[i + 1] END AS nxt FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM c)),
    h AS (SELECT w.*, ph.a IS NOT NULL AS hit FROM w LEFT JOIN ph ON w.t = ph.a AND w.nxt = ph.b),
    g AS (SELECT *, CASE WHEN hit THEN i - row_number() OVER (PARTITION BY doc_id, hit ORDER BY i) END AS isl FROM h),
    k AS (SELECT *, hit AND row_number() OVER (PARTITION BY doc_id, hit, isl ORDER BY i) % 2 = 1 AS take FROM g),
    e AS (SELECT *, coalesce(lag(take) OVER (PARTITION BY doc_id ORDER BY i), false) AS eaten FROM k)
    SELECT doc_id, coalesce(x.text, '') AS text FROM c LEFT JOIN (SELECT doc_id, string_agg(CASE WHEN take THEN t || '_' || nxt ELSE t END, ' ' ORDER BY i) AS text FROM e WHERE NOT eaten GROUP BY doc_id) x USING (doc_id)"""
)
def mwe_join(s, d):
    best = P.top_half(_pmi(s, d), "lang").select("a", "b")
    return P.mwe_join(corpus(s, d), "doc_id", "tokens", best).select("doc_id", F.array_join("tokens", " ").alias("text"))


_BRAND_TOKEN = rf"SELECT CASE WHEN len(w) > 0 THEN array_to_string(w, '_') ELSE 'none' END AS brand FROM (SELECT regexp_extract_all({_ASCII.format('lower(brand)')}, '\w\w+') AS w FROM amazon_raw)"


@query(
    f"""SELECT phrase, sum(n)::BIGINT AS n FROM (SELECT array_to_string(list_filter(string_split(brand, '_'), lambda t: t NOT IN ('works', 'tools', 'store', 'visit', 'the') AND t != ''), '_') AS phrase,
        len(list_filter(string_split(brand, '_'), lambda t: t NOT IN ('works', 'tools', 'store', 'visit', 'the') AND t != '')) AS k, count(*) AS n FROM ({_BRAND_TOKEN}) GROUP BY brand HAVING count(*) >= {LEAST_BRAND})
    WHERE k >= 2 GROUP BY phrase"""
)
def brand_phrases(s, d):
    df = amazon(s, d).select(B.brand_token(F.col("brand")).alias("brand"))
    return P.brand_phrases(df, "brand", ["works", "tools", "store", "visit", "the"], LEAST_BRAND).select(F.array_join("phrase", "_").alias("phrase"), "n")


@query()
def lemmatize(s, d):
    df = corpus(s, d)
    return L.lemmatise_known(df, "doc_id", "tokens", L.vocabulary_words(df, "tokens")).select("doc_id", F.array_join("tokens", " ").alias("text"))


# --- vectors, models and evaluation

_LETTERS = rf"SELECT doc_id, lang, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{M}}]+'), lambda t: t != '') AS tokens FROM ({_WRITTEN})"


def letters(s: SparkSession, d: str) -> DataFrame:
    return written(s, d).select("doc_id", "lang", F.filter(F.split(F.lower("text"), r"[^\p{L}\p{M}]+"), lambda t: t != "").alias("tokens"))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM ({_LETTERS})) GROUP BY ALL")
def term_freq(s, d):
    return V.term_frequency(letters(s, d), "doc_id", "tokens")


_TFIDF = f"""(WITH c AS (SELECT * FROM ({_LETTERS}) WHERE len(tokens) > 0), p AS (SELECT DISTINCT doc_id, unnest(tokens) AS term FROM c), n AS (SELECT count(*) AS n FROM c),
    i AS (SELECT term, ln((n + 1) / (count(*) + 1)) + 1 AS idf FROM p, n GROUP BY term, n), w AS (SELECT doc_id, term, idf FROM p JOIN i USING (term)), m AS (SELECT doc_id, sqrt(sum(idf * idf)) AS norm FROM w GROUP BY doc_id)
    SELECT doc_id, term, idf / norm AS weight FROM w JOIN m USING (doc_id))"""


@query(f"SELECT doc_id, term, round(weight, 5) AS weight FROM {_TFIDF}")
def tfidf_binary(s, d):
    return V.tfidf(letters(s, d), "doc_id", "tokens").withColumn("weight", F.round("weight", 5))


@query("SELECT lang, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang)")
def class_weights(s, d):
    return M.class_weights(documents(s, d), "lang")


_COEF = f"(SELECT lang, term, sum(weight) / any_value(k) AS coef FROM {_TFIDF} JOIN (SELECT doc_id, lang FROM ({_WRITTEN}) WHERE lang IS NOT NULL) USING (doc_id) JOIN (SELECT lang, count(*) AS k FROM ({_WRITTEN}) GROUP BY lang) USING (lang) GROUP BY lang, term)"


def _coef(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    df = letters(s, d)
    weights = cut_lineage(V.tfidf(df, "doc_id", "tokens"))  # read by every later stage
    return df, weights, cut_lineage(M.mean_vectors(weights, df, "doc_id", "lang"))


@query(f"SELECT lang, term, round(coef, 6) AS coef FROM {_COEF}")
def centroid_coef(s, d):
    return _coef(s, d)[2].withColumn("coef", F.round("coef", 6))


_PREDICTED = f"(SELECT doc_id, lang AS predicted FROM (SELECT doc_id, k.lang, round(sum(weight * coef), 9) AS score FROM {_TFIDF} w JOIN {_COEF} k USING (term) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1)"


def _predicted(s: SparkSession, d: str) -> DataFrame:
    df, weights, coef = _coef(s, d)
    return M.decide(weights, coef, "doc_id", "lang").join(df.select("doc_id", F.col("lang").alias("label")), "doc_id")


@query(f"SELECT doc_id, predicted FROM {_PREDICTED}")
def centroid_predict(s, d):
    return _predicted(s, d).select("doc_id", "predicted")


_PAIRS = f"(SELECT d.lang AS label, p.predicted FROM {_PREDICTED} p JOIN documents d USING (doc_id) WHERE d.lang IS NOT NULL)"


@query(f"SELECT label, predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM {_PAIRS} GROUP BY label, predicted")
def confusion(s, d):
    return E.confusion(_predicted(s, d).filter(F.col("label").isNotNull()))


_REPORT = f"""(WITH p AS (SELECT * FROM {_PAIRS}), r AS (SELECT label, count(*) AS support, sum((label = predicted)::INT) AS hit FROM p GROUP BY label), q AS (SELECT predicted AS label, count(*) AS said FROM p GROUP BY predicted),
    x AS (SELECT label, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS p, hit / support AS r, support FROM r LEFT JOIN q USING (label))
    SELECT label, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, support FROM x)"""


@query(f"SELECT * FROM {_REPORT}")
def class_report(s, d):
    return E.report(_predicted(s, d).filter(F.col("label").isNotNull()))


@query(
    f"""SELECT 'macro' AS average, round(avg("precision"), 5) AS "precision", round(avg(recall), 5) AS recall, round(avg(f1), 5) AS f1 FROM {_REPORT}
    UNION ALL SELECT 'weighted', round(sum("precision" * support) / sum(support), 5), round(sum(recall * support) / sum(support), 5), round(sum(f1 * support) / sum(support), 5) FROM {_REPORT}"""
)
def class_report_summary(s, d):
    return E.report_summary(class_report(s, d))


@query(f"SELECT round(sum(h) / sum(n), 6) AS accuracy, round(avg(h / n), 6) AS balanced_accuracy FROM (SELECT label, count(*) AS n, sum((label = predicted)::INT) AS h FROM {_PAIRS} GROUP BY label)")
def accuracy_pair(s, d):
    return E.accuracy_pair(_predicted(s, d).filter(F.col("label").isNotNull()))


@query(f"SELECT * FROM (SELECT label, f1, row_number() OVER (ORDER BY f1 DESC, label) AS best, row_number() OVER (ORDER BY f1, label) AS worst FROM {_REPORT}) WHERE best <= 9 OR worst <= 9")
def best_worst_classes(s, d):
    from pyspark.sql import Window

    best = F.row_number().over(Window.orderBy(F.desc("f1"), "label")).cast("bigint")  # as many rows as classes
    worst = F.row_number().over(Window.orderBy("f1", "label")).cast("bigint")
    return class_report(s, d).select("label", "f1", best.alias("best"), worst.alias("worst")).filter((F.col("best") <= 9) | (F.col("worst") <= 9))


@query(f'SELECT lang, term, round(coef, 6) AS coef, row_number() OVER (PARTITION BY lang ORDER BY round(coef, 9) DESC, term) AS "rank" FROM {_COEF} QUALIFY "rank" <= 20')
def top_terms_per_class(s, d):
    return E.top_terms(_coef(s, d)[2], "lang", 20).withColumn("coef", F.round("coef", 6))


_SCORES = f"(SELECT w.doc_id, w.term, w.weight * k.coef AS score FROM {_TFIDF} w JOIN {_PREDICTED} p USING (doc_id) JOIN {_COEF} k ON k.term = w.term AND k.lang = p.predicted)"


def _scores(s: SparkSession, d: str) -> DataFrame:
    _, weights, coef = _coef(s, d)
    return W.attribution(weights, coef, M.decide(weights, coef, "doc_id", "lang"), "doc_id", "lang")


@query(f"SELECT doc_id, term, round(score, 6) AS score FROM {_SCORES}")
def explain_keywords(s, d):
    return _scores(s, d).withColumn("score", F.round("score", 6))


@query(
    f"""SELECT doc_id, term, round(CASE WHEN hi - lo > 1e-9 THEN (score - lo) / (hi - lo) ELSE 0 END, 5) AS scaled
    FROM (SELECT *, min(score) OVER (PARTITION BY doc_id) AS lo, max(score) OVER (PARTITION BY doc_id) AS hi FROM (SELECT doc_id, term, round(score, 9) AS score FROM {_SCORES}))"""
)
def minmax_keywords(s, d):
    return W.scaled(_scores(s, d).withColumn("score", F.round("score", 9)), "doc_id").select("doc_id", "term", F.round("scaled", 5).alias("scaled"))


@query(
    f"""SELECT doc_id, string_agg(term, '+' ORDER BY r) AS query FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, term) AS r FROM {_SCORES}) WHERE r <= 3 GROUP BY doc_id"""
)
def keyword_query(s, d):
    return W.top_keywords(_scores(s, d), "doc_id").select("doc_id", "query")


def _train(s: SparkSession, d: str) -> DataFrame:
    df = A.split_by_lot(written(s, d).filter(F.col("lang").isNotNull()).select("doc_id", "text", F.col("lang").alias("label")), "doc_id")
    return cut_lineage(M.with_weights(df, "label"))  # as many partitions as its bytes need, and read in every iteration


@query()
def svm_ovr(s, d):
    df = _train(s, d)
    model = M.linear("svm", alpha=1e-4).fit(df.filter("is_train"))
    return M.labelled(model, model.transform(df.filter("not is_train"))).select("doc_id", "label", "predicted")


@query()
def logreg(s, d):
    df = _train(s, d)
    model = M.linear("log", alpha=1e-4, penalty="l1").fit(df.filter("is_train"))
    return M.labelled(model, model.transform(df.filter("not is_train"))).select("doc_id", "label", "predicted")


@query()
def sgd_classifier(s, d):
    df = _train(s, d)
    model = Sgd(loss="modified_huber", schedule="adaptive", eta0=1.0, average=True).fit(df.filter("is_train"))
    return model.transform(df.filter("not is_train"), ["doc_id", "label"])


#: What each classifier must reach on the quarter of the documents that it wasn't fitted on.
LEAST_ACCURACY = 0.95
_MODELS = ("svm", "log", "sgd hinge optimal", "sgd squared_hinge adaptive", "sgd modified_huber constant")


@query(f"SELECT unnest({list(_MODELS)}) AS model, true AS good")
def model_accuracy(s, d):
    """Each classifier, and whether its held-out accuracy is at least ``LEAST_ACCURACY``."""
    df = _train(s, d)
    train, test = df.filter("is_train"), df.filter("not is_train")
    said = {}
    for name in _MODELS[:2]:
        model = M.linear(name, alpha=1e-4).fit(train)
        said[name] = M.labelled(model, model.transform(test)).select("label", "predicted")
    for name in _MODELS[2:]:
        _, loss, schedule = name.split()
        said[name] = Sgd(loss=loss, schedule=schedule, eta0=1.0, steps=20).fit(train).transform(test, ["label"])
    right = [(name, E.accuracy_pair(x).first()["accuracy"] >= LEAST_ACCURACY) for name, x in said.items()]  # one number a model
    return s.createDataFrame(right, "model string, good boolean")


@query()
def linear_coefficients(s, d):
    """(label, term, coef, rank): the ten terms that speak most for each class of the linear model."""
    model = M.linear("log", alpha=1e-4).fit(_train(s, d).filter("is_train"))
    return E.top_terms(E.coefficients(model), "label", 10)


@query("SELECT true AS fitted, false AS unfitted")
def fitted_probe(s, d):
    model = M.linear("log", alpha=1e-2).fit(_train(s, d).filter("is_train"))
    return s.createDataFrame([(E.is_fitted(model), E.is_fitted(M.linear("log")))], "fitted boolean, unfitted boolean")


@query()
def halving_search(s, d):
    df = written(s, d).filter(F.col("lang").isNotNull()).select("doc_id", "text", F.col("lang").alias("label"))
    return M.cv_table(s, M.halving_search(df, "doc_id", grid=9, first=1000, kinds=("svm", "log", "sgd")))


# --- sources and sinks, pipelines


@query("SELECT main_cat, count(*) AS n FROM walmart GROUP BY main_cat")
def partitioned_roundtrip(s, d):
    path = scratch_path(s, "partitioned")
    df = walmart(s, d).select("item_id", "title", "main_cat")
    io.checkpoint(df, path)
    return io.read_checkpoint(s, path, df.schema).groupBy("main_cat").agg(F.count("*").alias("n"))


@query("SELECT asin, description, title, feature, brand, main_cat FROM amazon_raw")
def json_scan(s, d):
    path = scratch_path(s, "json")
    amazon(s, d).select(*RAW.names).write.option("ignoreNullFields", "true").json(path, compression="gzip")
    return io.scan_json_lines(s, path, partitions=s.sparkContext.defaultParallelism)


@query("SELECT asin, description, title, feature, brand, main_cat FROM amazon_raw")
def json_to_parquet(s, d):
    source, target = scratch_path(s, "json"), scratch_path(s, "converted")
    amazon(s, d).select(*RAW.names).write.json(source)
    io.convert(s, source, target)
    return io.scan(s, target, RAW.names)


@query("SELECT item_id, title, category, description, brand FROM walmart WHERE coalesce(title, category, description, brand) IS NOT NULL")
def csv_scan(s, d):
    """Line breaks, quotes and commas inside values, and nulls, come back as they were."""
    path = scratch_path(s, "csv")
    rows = walmart(s, d).select("item_id", "title", "category", "description", "brand").filter(F.coalesce("title", "category", "description", "brand").isNotNull())
    rows.na.fill("\\N").write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    schema = T.StructType([T.StructField("item_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("title", "category", "description", "brand")]])
    back = io.scan_csv(s, path, None, schema, multi_line=True)
    return back.select("item_id", *[F.when(F.coalesce(c, F.lit("")) != "\\N", F.coalesce(c, F.lit(""))).alias(c) for c in ("title", "category", "description", "brand")])


@query("SELECT title, category, count(*) AS n FROM walmart WHERE title IS NOT NULL AND category IS NOT NULL GROUP BY ALL")
def retail_ingest(s, d):
    """The retail file under its own column names, read by its schema, renamed and mapped to the other tables' names."""
    path = scratch_path(s, "retail")
    rows = walmart(s, d).filter("title IS NOT NULL AND category IS NOT NULL")
    rows.select(F.col("title").alias("Product Name"), F.col("category").alias("Category"), F.regexp_replace("description", r"\s+", " ").alias("Description"), F.col("brand").alias("Brand")).write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return io.rename_retail(io.scan_csv(s, path)).groupBy("title", "category").agg(F.count("*").alias("n"))


@query("SELECT row_id, title FROM amazon_raw")
def write_table(s, d):
    path = scratch_path(s, "table")
    io.write(amazon(s, d).select("row_id", "title"), path)
    return io.scan(s, path)


@query("SELECT asin, lang FROM lang_cache")
def cache_roundtrip(s, d):
    path = scratch_path(s, "cache")
    io.save_cache(table(s, d, "lang_cache").select("asin", "lang"), path)
    return io.scan(s, path, ["asin", "lang"])


@query("SELECT * FROM (VALUES (0, 'lamp'), (1, 'größe'), (2, 'x_y')) t(i, value)")
def parameters_roundtrip(s, d):
    path = scratch_path(s, "parameters.json")
    io.save_parameters(s, ["lamp", "größe", "x_y"], path)
    return s.createDataFrame(list(enumerate(io.load_parameters(s, path))), "i int, value string")


@query("SELECT true AS written, true AS removed, false AS there")
def remove_table(s, d):
    path = scratch_path(s, "gone")
    io.write(table(s, d, "category_list"), path)
    return s.createDataFrame([(io.exists(s, path), io.remove(s, path), io.exists(s, path))], "written boolean, removed boolean, there boolean")


@query(f"SELECT DISTINCT t AS word FROM (SELECT unnest(regexp_extract_all(lower(brand), '[a-z_]{{2,16}}')) AS t FROM brand_list UNION ALL SELECT unnest({_STOP})) ORDER BY word")
def stopword_union(s, d):
    """The list of stopwords with the words of all brands, which are a short list, cut as the corpus is."""
    brands = [r[0] for r in table(s, d, "brand_list").select("brand").collect()]
    return s.createDataFrame([(w,) for w in sorted(K.with_stopwords(K.STOPWORDS, brands))], "word string")


@query()
def pipeline_roundtrip(s, d):
    df = _train(s, d).filter("is_train")
    model = M.linear("log", alpha=1e-3).fit(df)
    path = scratch_path(s, "model")
    io.save_model(model, path)
    return pipelines.classify(io.load_model(path), documents(s, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select("doc_id", "predicted")


@query()
def curate_catalogue(s, d):
    return pipelines.curate(amazon(s, d), least_category=20)


@query()
def build_vocabulary(s, d):
    clean = pipelines.curate(amazon(s, d), least_category=20)
    return pipelines.vocabulary_stage(clean, table(s, d, "lang_cache"), least=LEAST_BIGRAM, least_brand=LEAST_BRAND)


@query()
def demo_table(s, d):
    return pipelines.demo_table(walmart(s, d))
