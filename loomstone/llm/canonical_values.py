"""Problem 7: freely typed values mapped to a reference list, by SQL alone.

Distinct values are cleaned and give probes: the whole value, its first words, and its parts in the order of the
list where a comma turned them. A pigeonhole join finds near entries: an entry cut into k + 1 segments within k edits
of a probe shares one segment with it, at a place shifted by at most k. Equality joins on (length, segment, text)
give the candidates, the built-in Levenshtein distance verifies them, and an anti-join reports what stays unmatched.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame

from ..runtime import cut_lineage
from .lookalike import CYRILLIC_AS_LATIN, GREEK_AS_LATIN

#: Words around a name that are no part of it.
PREFIXES = ("visit the", "brand:", "brand", "by", "from", "sold by", "made by", "manufactured by", "the")
SUFFIXES = ("official shop", "official store", "official", "store", "shop", "incorporated", "inc", "gmbh", "co ltd", "co", "ltd", "llc", "corp", "corporation", "company", "ag", "kg", "sa", "srl", "spa", "bv", "oy", "ab", "plc", "limited")
#: Values that stand for no brand.
NO_BRAND = ("generic", "unknown", "various", "n a", "na", "none", "null", "nil", "unbranded", "no brand", "nobrand", "no name", "noname", "not specified", "not available", "not applicable", "unspecified", "misc", "other", "others", "tbd")

#: Letters from which a name may be two edits away.
LONG = 12


def _folding() -> tuple[str, str]:
    """Letters and the plain Latin letter each comes to: accents off, full-width and look-alike letters to Latin."""
    pairs: dict[str, str] = {}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).lower()
        if len(plain) == 1 and plain != chr(c):
            pairs[chr(c)] = plain
    for theirs, latin in (CYRILLIC_AS_LATIN, GREEK_AS_LATIN):
        pairs.update(zip(theirs, latin.lower()))
        pairs.update((a.lower(), b.lower()) for a, b in zip(theirs, latin))
    pairs = {a: b for a, b in pairs.items() if a not in "'\\" and b not in "'\\"}
    return "".join(pairs), "".join(pairs.values())


def clean_sql(column: str, dialect: str = "spark") -> str:
    """SQL of the cleaned form of a value: folded letters and digits in words, additions taken off."""
    every = ", 'g'" if dialect == "duckdb" else ""
    raw = (lambda p: "'" + p + "'") if dialect == "duckdb" else (lambda p: "r'" + p + "'")
    swap = lambda e, p, by: f"regexp_replace({e}, {raw(p)}, '{by}'{every})"
    a, b = _folding()
    e = f"lower(translate({column}, '{a}', '{b}'))"
    e = swap(e, "[\\p{Cf}\\p{Mn}]", "")  # invisible characters and separate accents
    e = swap(e, "[^\\p{L}\\p{N},:]+", " ")
    e = f"trim({swap(e, ' *([,:]) *', '\\1' if dialect == 'duckdb' else '$1')})"
    e = swap(e, f"^(({'|'.join(PREFIXES)})[ :]+)+", "")
    for _ in range(2):
        e = swap(e, f"([ ,]+({'|'.join(x.replace(' ', '[ ,]*') for x in SUFFIXES)}))+[ ,]*$", "")
    return f"trim({swap(e, '(^[ ,:]+|[ ,:]+$)', '')})"


def map_values(df: DataFrame, reference: DataFrame, key: str = "row_id", value: str = "brand", ref_id: str = "brand_id", ref_value: str = "brand") -> DataFrame:
    """(key, ref_id): each row whose value is neither null nor blank, with the entry it names, or 0.

    A value fits an entry if, cleaned, its first words are the entry but for one edit or one swap of neighbours, or for
    two edits in a name of ``LONG`` letters or more; the most words and then the longest entry win, then the nearest, then the smallest id. An entry of several words is
    also named by its first word, if no other entry has that first word. An empty table or list gives no row or only
    zeros; repeated rows repeat.
    """
    spark = df.sparkSession
    no_brand = ", ".join(f"'{x}'" for x in NO_BRAND)
    query = rf"""
        WITH cleaned AS (SELECT DISTINCT c FROM vals WHERE c != '' AND c NOT IN ({no_brand})),
        turned AS (
            SELECT c, replace(c, ',', ' ') AS t FROM cleaned
            UNION SELECT c, concat_ws(' ', split_part(c, ',', 2), split_part(c, ',', 1)) FROM cleaned WHERE c LIKE '%,%'),
        words AS (SELECT c, split(trim(regexp_replace(t, '[ :]+', ' ')), ' ') AS w FROM turned),
        entries AS (SELECT `{ref_id}` AS id, trim(replace({clean_sql(f'`{ref_value}`')}, ',', ' ')) AS e FROM @reference WHERE `{ref_value}` IS NOT NULL),
        most AS (SELECT coalesce(max(size(split(e, ' '))), 0) + 2 AS m FROM entries),  -- more words are more than two edits away
        probes AS (SELECT DISTINCT c, n, array_join(slice(w, 1, n), ' ') AS p FROM (SELECT c, w, explode(sequence(1, least(size(w), (SELECT m FROM most)))) AS n FROM words)),
        firsts AS (SELECT split_part(e, ' ', 1) AS f, count(*) AS m, max(id) AS id, max(e) AS e FROM entries GROUP BY split_part(e, ' ', 1)),
        names AS (
            SELECT id, e AS name, false AS short FROM entries WHERE e != ''
            UNION ALL SELECT id, f, true FROM firsts WHERE m = 1 AND f != e AND f != ''),
        cut AS (SELECT id, name, short, length(name) AS l, explode(sequence(0, 2)) AS i FROM names),
        segments AS (SELECT id, name, short, l, i, i * l div 3 AS at, substring(name, 1 + i * l div 3, (i + 1) * l div 3 - i * l div 3) AS seg FROM cut),
        texts AS (SELECT DISTINCT p, length(p) AS pl FROM probes),
        lengths AS (SELECT p, pl, explode(sequence(greatest(pl - 2, 1), pl + 2)) AS l FROM texts),
        places AS (SELECT p, pl, l, i, i * l div 3 AS at, (i + 1) * l div 3 - i * l div 3 AS sl, explode(sequence(-2, 2)) AS shift FROM (SELECT *, explode(sequence(0, 2)) AS i FROM lengths)),
        pieces AS (SELECT DISTINCT p, l, i, substring(p, 1 + at + shift, sl) AS seg FROM places WHERE at + shift >= 0 AND at + shift + sl <= pl),
        candidates AS (SELECT DISTINCT x.p, s.id, s.name, s.short FROM pieces x JOIN segments s ON x.l = s.l AND x.i = s.i AND x.seg = s.seg),
        near AS (SELECT *, levenshtein(p, name) AS d FROM candidates),
        verified AS (
            SELECT p, id, name, short, d FROM near
            WHERE d = 0 OR (length(name) > 3 AND (d = 1 OR (d = 2 AND (length(name) >= {LONG} OR length(p) = length(name) AND array_sort(split(p, '')) = array_sort(split(name, ''))))))),
        best AS (
            SELECT c, min_by(id, struct(-size(split(name, ' ')), -length(name) * int(d = 0), d, short, -length(name), id)) AS id
            FROM probes JOIN verified USING (p) GROUP BY c),
        matched AS (SELECT v, id FROM vals JOIN best USING (c)),
        unmatched AS (SELECT v, CAST(0 AS BIGINT) AS id FROM vals LEFT ANTI JOIN matched USING (v)),
        mapping AS (SELECT * FROM matched UNION ALL SELECT * FROM unmatched)
        SELECT t.`{key}`, CAST(g.id AS BIGINT) AS `{ref_id}` FROM @typed t JOIN mapping g ON t.`{value}` = g.v
        """
    # the distinct values are cleaned once and written, as the plan reads them several times
    cleaned = rf"""
        SELECT v, {clean_sql('v')} AS c FROM (SELECT DISTINCT `{value}` AS v FROM @typed)
        WHERE v IS NOT NULL AND trim(regexp_replace(v, r'[\s\p{{Z}}]+', '')) != ''"""
    braces = lambda q: q.replace("{", "{{").replace("}", "}}").replace("@typed", "{typed}").replace("@reference", "{reference}").replace("vals ", "{vals} ")
    vals = cut_lineage(spark.sql(braces(cleaned), typed=df.select(value)))
    return spark.sql(braces(query), typed=df.select(key, value), reference=reference, vals=vals)
