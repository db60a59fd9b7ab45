"""Problem 2: records that differ only in layout, collapsed to one each with the number of copies.

Byte-identical rows collapse first, with counts and within each map task already, so that a hot record is one row
before it is shuffled. Only the distinct survivors are brought to their canonical text, and are grouped again on all
of that text, summing the counts. All of it is built-in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut_lineage

#: Letters whose case pairs differ in length or have two small forms.
FOLDS = (("ß", "ss"), ("ς", "σ"), ("ſ", "s"))


def letters_and_digits(c: Column) -> Column:
    """The letters and digits of a text in their order, without regard to case; null stays null."""
    c = F.lower(c)
    for a, b in FOLDS:
        c = F.replace(c, F.lit(a), F.lit(b)) if len(a) != len(b) else F.translate(c, a, b)
    return F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")


def canonical(df: DataFrame, column: str) -> Column:
    """Canonical text of a string column; of an array, the sorted canonical elements that are not empty."""
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return F.array_sort(F.filter(F.transform(column, lambda x: letters_and_digits(F.coalesce(x, F.lit("")))), lambda x: x != ""))
    return letters_and_digits(F.col(column))


def raw_digest(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the columns' exact values, nulls and element borders told apart."""
    part = []
    for c in columns:
        if isinstance(df.schema[c].dataType, T.ArrayType):
            items = F.transform(c, lambda x: F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")))
            part.append(F.coalesce(F.concat(F.size(c).cast("string"), F.lit("["), F.array_join(items, ",")), F.lit("-")))
        else:
            part.append(F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")))
    return F.sha2(F.concat_ws("|", *part), 256)


def _survivors(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(_raw, _rep, _n, columns..) of every distinct raw record: its digest, its smallest key, its number of copies.

    Only digests and counts are aggregated; the texts are fetched for the survivors alone.
    """
    digest = raw_digest(df, columns)
    raw = df.select(digest.alias("_raw"), F.col(key).alias("_rep")).groupBy("_raw").agg(F.min("_rep").alias("_rep"), F.count("*").alias("_n"))
    texts = df.select(F.col(key).alias("_rep"), *columns, digest.alias("_own"))
    return texts.join(raw, "_rep").filter(F.col("_own") == F.col("_raw")).drop("_own")


def _canonical_columns(survivors: DataFrame, columns: list[str]) -> list[Column]:
    return [canonical(survivors, c).alias(f"_c{i}") for i, c in enumerate(columns)]


def collapse_copies(df: DataFrame, key: str = "row_id", columns: tuple[str, ...] = ("title", "brand", "description")) -> DataFrame:
    """One row per distinct listing: all columns of its row of the smallest key, and ``n_copies`` BIGINT.

    Two rows are copies if the ``columns`` hold the same letters and digits in the same order without regard to case,
    the order of an array's elements aside; a null equals only a null, and an array without letters equals an empty
    one. Rows whose columns are all null form one listing. An empty table gives an empty table.
    """
    cols = list(columns)
    survivors = _survivors(df, key, cols)
    distinct = survivors.select("_rep", "_n", *_canonical_columns(survivors, cols)).distinct()  # rows of one key are one
    listing = distinct.groupBy(*[f"_c{i}" for i in range(len(cols))]).agg(F.min("_rep").alias(key), F.sum("_n").alias("n_copies"))
    return df.join(listing.select(key, "n_copies"), key)


def copy_members(df: DataFrame, key: str = "row_id", columns: tuple[str, ...] = ("title", "brand", "description"), least: int = 2) -> DataFrame:
    """(key, gid, n_copies) of every row whose listing has at least ``least`` rows; gid is the listing's smallest key.

    Canonical texts meet as SHA-256 digests; a pair of different texts under one digest is not to be expected.
    """
    cols = list(columns)
    survivors = _survivors(df, key, cols)
    part = [F.coalesce(F.concat(F.size(x).cast("string"), F.lit("["), F.array_join(x, ",")) if isinstance(df.schema[c].dataType, T.ArrayType) else x, F.lit("-")) for c, x in ((c, canonical(survivors, c)) for c in cols)]
    slim = survivors.select("_raw", "_rep", "_n", F.sha2(F.concat_ws("|", *part), 256).alias("_canon")).distinct()
    slim = cut_lineage(slim)
    listing = slim.groupBy("_canon").agg(F.min("_rep").alias("gid"), F.sum("_n").alias("n_copies")).filter(F.col("n_copies") >= least)
    raw_to = slim.select("_raw", "_canon").join(listing, "_canon").select("_raw", "gid", "n_copies")
    return df.select(key, raw_digest(df, cols).alias("_raw")).join(raw_to, "_raw").select(key, "gid", "n_copies")


def copy_representatives(df: DataFrame, key: str = "row_id", columns: tuple[str, ...] = ("title", "brand", "description")) -> DataFrame:
    """(key, gid, n_copies) of every row: gid is the smallest key of its listing, its own where it has no copy."""
    return copy_members(df, key, columns, 1)


def copy_pairs(df: DataFrame, key: str = "row_id", columns: tuple[str, ...] = ("title", "brand", "description")) -> DataFrame:
    """(key_a, key_b): all pairs of copies, the smaller key first."""
    members = copy_members(df, key, columns)
    a, b = members.select("gid", F.col(key).alias(f"{key}_a")), members.select("gid", F.col(key).alias(f"{key}_b"))
    return a.join(b, "gid").filter(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")
