"""The queries of the ten problems and, where SQL can say them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import cut_lineage, table
from .bpe import encode_corpus
from .canonical_values import LONG, NO_BRAND, clean_sql, map_values
from .languages import listing_languages, missing_or_wrong
from .layout_copies import collapse_copies, copy_pairs, copy_representatives
from .lookalike import found_fields, normalise_lookalikes
from .markup import clean_listings, marked_fields
from .packing import pack, space_left, violations
from .repeats import repeated_runs
from .residue import exclude_residue, score_residue
from .same_product import product_groups, product_members, product_pairs
from .sentences import sentences

Query = Callable[[SparkSession, str], DataFrame]


def _p1_found(spark: SparkSession, d: str) -> DataFrame:
    return found_fields(table(spark, d, "amazon_raw"), "row_id", ["brand", "description"])


def _p1_forms(spark: SparkSession, d: str) -> DataFrame:
    return normalise_lookalikes(table(spark, d, "amazon_raw"), ["brand", "description"], keep=["row_id"])


def _p2_found(spark: SparkSession, d: str) -> DataFrame:
    return copy_pairs(table(spark, d, "amazon_raw"))


def _p2_listings(spark: SparkSession, d: str) -> DataFrame:
    return collapse_copies(table(spark, d, "amazon_raw")).select("row_id", "title", "brand", "n_copies")


def _p2_members(spark: SparkSession, d: str) -> DataFrame:
    return copy_representatives(table(spark, d, "amazon_raw"))


def _p3_found(spark: SparkSession, d: str) -> DataFrame:
    return score_residue(table(spark, d, "walmart")).filter("is_residue").select("item_id").distinct()


def _p3_kept(spark: SparkSession, d: str) -> DataFrame:
    return exclude_residue(table(spark, d, "walmart"))


def _p4_found(spark: SparkSession, d: str) -> DataFrame:
    return marked_fields(table(spark, d, "amazon_raw"), "row_id", ["title", "main_cat", "description"])


def _p4_listings(spark: SparkSession, d: str) -> DataFrame:
    return clean_listings(table(spark, d, "amazon_raw"), table(spark, d, "category_list"))


def _p4_repeats(spark: SparkSession, d: str) -> DataFrame:
    return repeated_runs(table(spark, d, "amazon_raw"), "row_id", "description").select("row_id", "n_words", "n_repeated")


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return product_groups(table(spark, d, "walmart"), table(spark, d, "amazon_raw"))


def _p5_found(spark: SparkSession, d: str) -> DataFrame:
    return product_pairs(_groups(spark, d))


def _p5_members(spark: SparkSession, d: str) -> DataFrame:
    return product_members(_groups(spark, d))


def _p6_found(spark: SparkSession, d: str) -> DataFrame:
    return missing_or_wrong(table(spark, d, "walmart"), table(spark, d, "amazon_raw"), table(spark, d, "lang_cache"))


def _p6_languages(spark: SparkSession, d: str) -> DataFrame:
    return listing_languages(table(spark, d, "walmart"), table(spark, d, "amazon_raw"), table(spark, d, "lang_cache"))


def _p7_found(spark: SparkSession, d: str) -> DataFrame:
    return map_values(table(spark, d, "amazon_raw"), table(spark, d, "brand_list"))


def _p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def _p9_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"), table(spark, d, "container_sizes"))


def _p9_space(spark: SparkSession, d: str) -> DataFrame:
    return space_left(_p9_packed(spark, d), table(spark, d, "container_sizes"))


def _p9_violations(spark: SparkSession, d: str) -> DataFrame:
    return violations(cut_lineage(_p9_packed(spark, d)), table(spark, d, "documents"), table(spark, d, "container_sizes"))


def _p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {
    "p1_found": _p1_found,
    "p1_forms": _p1_forms,
    "p2_found": _p2_found,
    "p2_listings": _p2_listings,
    "p2_members": _p2_members,
    "p3_found": _p3_found,
    "p3_kept": _p3_kept,
    "p4_found": _p4_found,
    "p4_listings": _p4_listings,
    "p4_repeats": _p4_repeats,
    "p5_found": _p5_found,
    "p5_members": _p5_members,
    "p6_found": _p6_found,
    "p6_languages": _p6_languages,
    "p7_found": _p7_found,
    "p8_ids": _p8_ids,
    "p9_packed": _p9_packed,
    "p9_space": _p9_space,
    "p9_violations": _p9_violations,
    "p10_found": _p10_found,
}

_CASES = (
    r"[\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{0300}-\x{036F}\x{00A0}\x{1680}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{2064}\x{FEFF}\x{00AD}\x{3099}\x{309A}]"
    r"|(?:^|[^\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}])\x{3000}(?:$|[^\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}])"
    r"|\p{Latin}[\p{N}\p{M}]*[\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}][\p{N}\p{M}]*\p{Latin}|\p{Greek}[\p{N}\p{M}]*\p{Cyrillic}|\p{Cyrillic}[\p{N}\p{M}]*\p{Greek}"
)
_LETTERS = r"regexp_replace(replace(replace(replace(lower({}), 'ß', 'ss'), 'ς', 'σ'), 'ſ', 's'), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_COPIES = f"""
    SELECT row_id, title, brand, {_LETTERS.format('title')} AS t, {_LETTERS.format('brand')} AS b,
        list_sort(list_filter(list_transform(description, lambda x: {_LETTERS.format("coalesce(x, '')")}), lambda x: x != '')) AS d
    FROM amazon_raw"""
_NO_BRAND = ", ".join(f"'{x}'" for x in NO_BRAND)

ORACLES: dict[str, str] = {
    "p1_found": f"""
        SELECT row_id, 'brand' AS field FROM amazon_raw WHERE regexp_matches(brand, '{_CASES}')
        UNION ALL SELECT row_id, 'description' FROM amazon_raw WHERE len(list_filter(description, lambda x: regexp_matches(x, '{_CASES}'))) > 0""",
    "p2_found": f"""
        WITH c AS ({_COPIES})
        SELECT x.row_id AS row_id_a, y.row_id AS row_id_b FROM c x JOIN c y
            ON x.t IS NOT DISTINCT FROM y.t AND x.b IS NOT DISTINCT FROM y.b AND x.d IS NOT DISTINCT FROM y.d AND x.row_id < y.row_id""",
    "p2_listings": f"""
        WITH c AS ({_COPIES}), g AS (SELECT min(row_id) AS row_id, count(*) AS n_copies FROM c GROUP BY t, b, d)
        SELECT row_id, title, brand, n_copies FROM g JOIN c USING (row_id)""",
    "p2_members": f"""
        WITH c AS ({_COPIES}), g AS (SELECT t, b, d, min(row_id) AS gid, count(*) AS n_copies FROM c GROUP BY t, b, d)
        SELECT row_id, gid, n_copies FROM c JOIN g ON c.t IS NOT DISTINCT FROM g.t AND c.b IS NOT DISTINCT FROM g.b AND c.d IS NOT DISTINCT FROM g.d""",
    "p4_repeats": r"""
        WITH r AS (SELECT row_id, regexp_extract_all(coalesce(array_to_string(description, ' '), ''), '\S+') AS w FROM amazon_raw),
        x AS (SELECT row_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT row_id, w, unnest(range(1, len(w) - 6)) AS i FROM r)),
        t AS (SELECT s FROM x GROUP BY s HAVING min(row_id) < max(row_id)),
        c AS (SELECT row_id, count(DISTINCT i + j) AS n FROM x JOIN t USING (s), range(0, 8) o(j) GROUP BY row_id)
        SELECT row_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_repeated FROM r LEFT JOIN c USING (row_id)""",
    "p9_violations": "SELECT container_id, '' AS what, 0::BIGINT AS n FROM container_sizes WHERE false",
    "p7_found": f"""
        WITH vals AS (SELECT DISTINCT brand AS v FROM amazon_raw WHERE regexp_replace(brand, '[\\s\\p{{Z}}]+', '', 'g') != ''),
        cleaned AS (SELECT v, {clean_sql('v', 'duckdb')} AS c FROM vals),
        turned AS (
            SELECT DISTINCT c, string_split(trim(regexp_replace(t, '[ :]+', ' ', 'g')), ' ') AS w FROM (
                SELECT c, replace(c, ',', ' ') AS t FROM cleaned WHERE c != '' AND c NOT IN ({_NO_BRAND})
                UNION SELECT c, concat_ws(' ', split_part(c, ',', 2), split_part(c, ',', 1)) FROM cleaned WHERE c LIKE '%,%' AND c NOT IN ({_NO_BRAND}))),
        probes AS (SELECT DISTINCT c, array_to_string(w[1:n], ' ') AS p FROM (SELECT c, w, unnest(range(1, len(w) + 1)) AS n FROM turned)),
        entries AS (SELECT brand_id AS id, trim(replace({clean_sql('brand', 'duckdb')}, ',', ' ')) AS e FROM brand_list WHERE brand IS NOT NULL),
        firsts AS (SELECT split_part(e, ' ', 1) AS f, max(id) AS id, max(e) AS e FROM entries GROUP BY 1 HAVING count(*) = 1),
        names AS (SELECT id, e AS name, 0 AS short FROM entries UNION ALL SELECT id, f, 1 FROM firsts WHERE f != e),
        near AS (
            SELECT c, id, name, short, levenshtein(p, name) AS d, p FROM probes, names WHERE abs(length(p) - length(name)) <= 2),
        fits AS (
            SELECT * FROM near WHERE d = 0 OR (length(name) > 3 AND (d = 1 OR (d = 2 AND (length(name) >= {LONG} OR length(p) = length(name)
                AND list_sort(string_split(p, '')) = list_sort(string_split(name, ''))))))),
        best AS (
            SELECT c, id FROM fits QUALIFY row_number() OVER (PARTITION BY c ORDER BY len(string_split(name, ' ')) DESC,
                CASE WHEN d = 0 THEN length(name) ELSE 0 END DESC, d, short, length(name) DESC, id) = 1)
        SELECT row_id, coalesce(id, 0)::BIGINT AS brand_id FROM amazon_raw JOIN cleaned ON brand = v LEFT JOIN best USING (c)""",
}
