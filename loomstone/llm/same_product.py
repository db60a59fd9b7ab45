"""Problem 5: listings of one product, grouped within and across tables.

Each listing gives its standard identifiers (with a valid check digit), its part number, its brand, the words of its
title that can be a series name, and its size, colour and pack count in one unit. A word is a series name if nearly all
listings that have it are of one brand. Listings meet at keys: identifier, part number, or series name with all of size,
colour and pack. A key that leads to several part numbers, identifiers or brands is split by them, so that it joins no
two products that are told apart otherwise (the guard). Keys that a listing has together are edges, and a product is a
connected component of the keys. Copies in layout join their originals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut_lineage, spread
from .canonical_values import NO_BRAND, _folding, clean_sql
from .components import components
from .layout_copies import copy_members

#: Units of size, their dimension and their size in its base unit (mm, ml, g).
UNITS = {
    "mm": ("length", 1.0), "cm": ("length", 10.0), "m": ("length", 1000.0), "in": ("length", 25.4), "inch": ("length", 25.4), "inches": ("length", 25.4), '"': ("length", 25.4), "ft": ("length", 304.8),
    "ml": ("volume", 1.0), "cl": ("volume", 10.0), "dl": ("volume", 100.0), "l": ("volume", 1000.0), "litre": ("volume", 1000.0), "liter": ("volume", 1000.0), "fl oz": ("volume", 29.5735), "fl. oz": ("volume", 29.5735),
    "mg": ("mass", 0.001), "g": ("mass", 1.0), "kg": ("mass", 1000.0), "oz": ("mass", 28.3495), "lb": ("mass", 453.592), "lbs": ("mass", 453.592),
}
#: Colour words and the spelling that they come to.
COLOURS = {
    "navy blue": "navy", "navy": "navy", "dark blue": "navy", "light blue": "light blue", "sky blue": "light blue", "blue": "blue", "grey": "grey", "gray": "grey", "silver": "silver", "black": "black", "white": "white",
    "schwarz": "black", "weiß": "white", "rot": "red", "grün": "green", "gelb": "yellow", "grau": "grey", "blau": "blue", "noir": "black", "blanc": "white", "rouge": "red", "vert": "green", "negro": "black", "blanco": "white", "rojo": "red", "nero": "black", "bianco": "white", "rosso": "red", "preto": "black", "branco": "white", "burgundy": "burgundy", "magenta": "magenta", "teal": "teal", "charcoal": "charcoal", "bronze": "bronze", "copper": "copper", "lime": "lime", "olive": "olive", "maroon": "maroon", "lilac": "lilac", "khaki": "khaki",
    "red": "red", "green": "green", "yellow": "yellow", "orange": "orange", "violet": "violet", "purple": "violet", "beige": "beige", "brown": "brown", "pink": "pink", "gold": "gold", "turquoise": "turquoise", "ivory": "ivory", "cream": "cream",
}
PACK_OF = r"(?:pack|set|box|bundle|lot|case)\s*of\s*(\d{1,3})(?!\d)"
PACK = r"(?<![\d.])(\d{1,3})[\s-]*(?:pack|pcs|pc|pieces|piece|count|ct|units)(?![\p{L}])|(?<![\p{L}\d])x\s*(\d{1,3})(?![\p{L}\d.])|(?<![\d.])(\d{1,2})\s*x(?![\p{L}\d])"
#: Letters and digits in one or more parts: two to four letters and digits with gaps between, or any mixed word.
PART = r"(?<![a-z\d])(?:[a-z]{2,4}[\s-]?\d{3}[\s-]?\d{3,5}|(?=[a-z\d./-]*\d[a-z./-]*\d)(?=[a-z\d./-]*[a-z])[a-z\d]+(?:[./-][a-z\d]+)*)(?![a-z\d])"
#: What such a word is if it is none: a size, a pack count, a share.
NO_PART = r"^(?:\d+(?:[.,x/-]\d+)*[./-]?(?:fl|oz|mm|cm|ml|cl|dl|mg|kg|inches|inch|in|ft|lbs|lb|litres?|liters?|m|l|g|pack|pcs|pc|pieces|piece|count|ct|units|x|w|v|a|ah|mah|hz|gb|tb|mb|k|p|th|st|nd|rd|er|s|h|min|yrs?|years?)(?:x\d+[a-z]*)*|x\d+|[a-z]\d)$"
#: A part number for another product stands behind these.
FITS = r"(?<![a-z])(?:for|fits|fit|compatible with|replaces|suits|für|pour|para|per|для)\s+(?:the\s+)?(?:models?\s+)?$"
SIZE = r"(?<![\d.,])(\d+(?:\.\d+)?)\s*(fl\.?\s*oz|mm|cm|ml|cl|dl|mg|kg|inches|inch|in|ft|lbs|lb|litre|liter|oz|m|l|g|\")(?![\p{L}\d])"
#: Two sizes are one if they differ by less than this share, as rounding in another unit allows.
ROUNDING = 0.03
#: Share of the listings with a word that one brand must have for it to be a series name.
ONE_BRAND = 0.75


def folded(c: Column) -> Column:
    """Lower case with look-alike, full-width and accented letters as plain Latin, invisible characters taken out."""
    a, b = _folding()
    return F.when(c.rlike(r"\A[\x00-\x7F]*\z"), F.lower(c)).otherwise(F.lower(F.translate(F.regexp_replace(c, r"[\p{Cf}\p{Mn}]", ""), a, b)))


def valid_gtins(c: Column) -> Column:
    """The numbers of 12 to 14 digits in a text whose check digit is right, and those of 8 that are named so, to 14 digits."""
    long = F.regexp_extract_all(c, F.lit(r"(?<!\d)(\d{12,14})(?!\d)"), 1)
    short = F.regexp_extract_all(c, F.lit(r"(?i)(?:ean|gtin|upc|barcode)[\s:#.-]*(\d{8})(?!\d)"), 1)
    numbers = F.transform(F.concat(long, short), lambda x: F.lpad(x, 14, "0"))
    weigh = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.lit(0), lambda s, i: s + F.substring(x, i, F.lit(1)).cast("int") * (F.lit(1) + F.lit(2) * (i % 2)))
    return F.filter(numbers, lambda x: (weigh(x) % 10 == 0) & (x != "0" * 14))


def part_number(c: Column) -> Column:
    """The first part number of a folded text, in capital letters and digits alone; null without one.

    It has five characters or more, two of them digits and one a letter, and is no size or count; one behind ``for``
    or the like is another product's.
    """
    own = F.when(c.rlike(FITS[:-1]), F.regexp_replace(c, FITS[:-1] + PART, " ")).otherwise(c)
    words = F.regexp_extract_all(own, F.lit(PART), 0)
    bare = F.transform(F.filter(words, lambda x: ~x.rlike(NO_PART)), lambda x: F.upper(F.regexp_replace(x, r"[^a-z\d]", "")))
    return F.try_element_at(F.filter(bare, lambda x: (F.length(x) >= 5) & x.rlike("[A-Z]")), F.lit(1))


#: Words of sizes and counts, which name no series.
COUNT_WORDS = ("pack", "packs", "piece", "pieces", "count", "units", "unit", "bundle", "case", "inch", "inches", "litre", "litres", "liter", "liters", "model")


def features(listings: DataFrame) -> DataFrame:
    """Of (listing, title, body, brand): what a product is told by. A null title leaves the bracket of the body.

    Each step is a projection of its own, so that no pattern is searched twice for one row.
    """
    df = listings.select("listing", "brand", folded(F.coalesce("title", F.lit(""))).alias("_title"), F.coalesce("body", F.lit("")).alias("_raw"))
    df = df.withColumn("_part", part_number(F.col("_title"))).withColumn("_untitled", F.trim("_title") == "")
    # the body is read for a number or a bracket only where the title has none
    df = df.withColumn("_body", F.when(F.col("_part").isNull() | F.col("_untitled"), folded(F.col("_raw"))))
    bracket = F.regexp_extract(F.coalesce("_body", F.lit("")), r"[(\[]\s*model[^)\]]*[)\]]?", 0)
    df = df.withColumn("_told", F.regexp_replace(F.when(F.col("_untitled"), bracket).otherwise(F.col("_title")), r"\s+", " "))
    df = df.withColumn("_pack_of", F.regexp_extract("_told", PACK_OF, 1)).withColumn("_sized", F.when(F.col("_pack_of") == "", F.col("_told")).otherwise(F.regexp_replace("_told", PACK_OF, " ")))
    df = df.withColumn("_size", F.regexp_extract("_sized", SIZE, 0))
    df = df.withColumn("_count", F.when(F.col("_pack_of") == "", F.regexp_extract(F.when(F.col("_size") == "", F.col("_sized")).otherwise(F.regexp_replace("_sized", SIZE, " ")), PACK, 0)))
    df = df.withColumn("_number", F.regexp_extract("_size", r"^\d+(?:\.\d+)?", 0))
    df = df.withColumn("_unit", F.regexp_replace(F.trim(F.substring(F.col("_size"), F.length("_number") + 1, F.length("_size"))), r"fl\.? ?oz", "fl oz"))
    table = F.create_map(*[F.lit(x) for k, (d, v) in UNITS.items() for x in (k, v)])
    kinds = F.create_map(*[F.lit(x) for k, (d, v) in UNITS.items() for x in (k, d)])
    colour = F.regexp_extract("_told", r"(?<![\p{L}])(" + "|".join(sorted(COLOURS, key=len, reverse=True)) + r")(?![\p{L}])", 1)
    shade = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    words = F.regexp_extract_all(F.when(F.col("_untitled"), F.coalesce("_body", F.lit(""))).otherwise(F.col("_title")), F.lit(r"(?<![a-z\d])([a-z]{4,})(?![a-z\d])"), 1)
    gtins = lambda c: F.when(F.col(c).rlike(r"\d{8}"), valid_gtins(F.col(c))).otherwise(F.array().cast("array<string>"))
    return df.select(
        "listing",
        "brand",
        F.coalesce("_part", part_number(F.col("_body"))).alias("part"),
        F.array_distinct(F.concat(gtins("_title"), gtins("_raw"))).alias("gtins"),
        (F.col("_number").try_cast("double") * F.try_element_at(table, F.col("_unit"))).alias("size"),
        F.try_element_at(kinds, F.col("_unit")).alias("dimension"),
        F.try_element_at(shade, colour).alias("colour"),
        F.coalesce(F.col("_pack_of").try_cast("int"), F.regexp_extract("_count", r"\d+", 0).try_cast("int"), F.lit(1)).alias("pack"),
        F.array_distinct(F.array_except(words, F.array(*[F.lit(w) for w in COUNT_WORDS]))).alias("words"),
    )


def same_brand(a: Column, b: Column) -> Column:
    """Two cleaned brands are one if they, or their first words, differ by slips of the keyboard, of which each may have one or two."""
    x, y = F.split_part(a, F.lit(" "), F.lit(1)), F.split_part(b, F.lit(" "), F.lit(1))
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    near = lambda p, q: F.levenshtein(p, q) <= F.when(F.least(F.length(p), F.length(q)) >= 9, 4).when(F.least(F.length(p), F.length(q)) >= 7, 3).when(F.least(F.length(p), F.length(q)) >= 4, 1).otherwise(0)
    return near(x, y) | near(bare(a), bare(b))


def settled_brands(counts: DataFrame, group: list[str]) -> DataFrame:
    """(group.., brand, n, settled) of (group.., brand, n): each brand, or the most frequent one of its group that it is but for slips.

    What isn't the most frequent one of all is held against the most frequent of the rest with its first letter.
    """
    best = lambda: F.max_by("brand", F.struct("n", "brand"))
    told = counts.join(counts.groupBy(*group).agg(best().alias("_m")), group).withColumn("_same", same_brand(F.col("brand"), F.col("_m")))
    rest = told.filter(~F.col("_same")).withColumn("_l", F.substring("brand", 1, 1))
    second = rest.groupBy(*group, "_l").agg(best().alias("_m2"))
    again = rest.join(second, [*group, "_l"]).select(*group, "brand", "n", F.when(same_brand(F.col("brand"), F.col("_m2")), F.col("_m2")).otherwise(F.col("brand")).alias("settled"))
    return told.filter("_same").select(*group, "brand", "n", F.col("_m").alias("settled")).unionByName(again)


def series_words(words: DataFrame, settled: DataFrame, one_brand: float = ONE_BRAND) -> DataFrame:
    """(word): those of ``words`` (word) that nearly all listings of one brand have, by (word, settled, n).

    The measure is a share, so that it doesn't depend on the number of listings, of models or of their copies.
    """
    by = settled.groupBy("word", "settled").agg(F.sum("n").alias("n"))
    shares = by.groupBy("word").agg(F.max("n").alias("_most"), F.sum("n").alias("_all"))
    # no brand speaks against a word that none has
    return words.distinct().join(shares, "word", "left").filter(F.col("_all").isNull() | (F.col("_most") >= one_brand * F.col("_all"))).select("word")


def same_sizes(sizes: DataFrame, group: list[str], rounding: float = ROUNDING) -> DataFrame:
    """(group.., size, size0): each size with the least one of its cluster, a gap or twice its width beginning a new one.

    A group's distinct sizes, to four digits, are bounded by the ranges of the units, so each group is folded in a row.
    """
    def fold(acc: Column, x: Column) -> Column:
        anchor = F.element_at(acc, -1)
        fresh = F.size(acc) == 0
        begins = fresh | (x > anchor["size"] * (1 + rounding)) | (x > anchor["size0"] * (1 + 2 * rounding))
        return F.concat(acc, F.array(F.struct(x.alias("size"), F.when(begins, x).otherwise(anchor["size0"]).alias("size0"))))

    empty = F.array().cast("array<struct<size:double,size0:double>>")
    per = sizes.select(*group, "size").distinct().groupBy(*group).agg(F.array_sort(F.collect_list("size")).alias("_s"))
    return per.select(*group, F.explode(F.aggregate("_s", empty, fold)).alias("_x")).select(*group, "_x.size", "_x.size0")


def guarded(keys: DataFrame, *witnesses: str) -> DataFrame:
    """(listing, key): of (listing, key, witnesses..) each key, split by a witness of which its listings have several.

    Listings without that witness then share a part of their own. Whether there are several is told by the least and the
    greatest hash of a witness, in an aggregate of numbers, so a hot key is one row a task before it is shuffled.
    """
    told = keys.select("key", *[F.when(F.col(w).isNotNull(), F.xxhash64(w)).alias(w) for w in witnesses])
    several = told.groupBy("key").agg(*[x for w in witnesses for x in (F.min(w).alias(f"_lo_{w}"), F.max(w).alias(f"_hi_{w}"))])
    split = several.select("key", *[(F.col(f"_lo_{w}") < F.col(f"_hi_{w}")).alias(f"_two_{w}") for w in witnesses])
    split = split.filter(reduce(lambda a, b: a | b, [F.coalesce(f"_two_{w}", F.lit(False)) for w in witnesses]))  # few keys lead to several
    part = [F.when(F.col(f"_two_{w}"), F.concat(F.lit("|"), F.coalesce(w, F.lit("-")))).otherwise(F.lit("")) for w in witnesses]
    return keys.join(split, "key", "left").select("listing", F.concat("key", *part).alias("key"))


def listing_keys(listings: DataFrame, rounding: float = ROUNDING, one_brand: float = ONE_BRAND, names: DataFrame | None = None) -> DataFrame:
    """(listing, key) of (listing, title, body, brand): all keys of a listing, guarded; ``names`` are words of brands.

    What several later stages read is written: else each would compute it again.
    """
    f = cut_lineage(features(spread(listings)))
    told = f.filter(F.col("brand").isNotNull())
    of_word = told.select(F.lit("word").alias("kind"), F.explode("words").alias("word"), "brand")
    of_part = told.filter(F.col("part").isNotNull()).select(F.lit("part").alias("kind"), F.col("part").alias("word"), "brand")
    counts = cut_lineage(of_word.unionByName(of_part).groupBy("kind", "word", "brand").agg(F.count("*").alias("n")))
    settled = cut_lineage(settled_brands(counts, ["kind", "word"]))

    first = f.select("listing", "part", "brand", F.try_element_at("gtins", F.lit(1)).alias("gtin"), "words", "size", "dimension", "colour", "pack")
    none = F.lit(None).cast("string")
    by_gtin = f.select("listing", F.explode(F.transform("gtins", lambda g: F.concat(F.lit("gtin:"), g))).alias("key"), F.col("part").alias("w1"), none.alias("w2"), none.alias("w3"))
    parts = first.filter(F.col("part").isNotNull()).select("listing", "part", "brand", "gtin", "colour")
    named = settled.filter("kind = 'part'").select(F.col("word").alias("part"), "brand", "settled")
    by_part = parts.join(named, ["part", "brand"], "left").select("listing", F.concat(F.lit("part:"), "part").alias("key"), F.col("settled").alias("w1"), F.col("gtin").alias("w2"), F.col("colour").alias("w3"))

    colours = [w for c in COLOURS for w in c.split() if len(w) >= 4]
    sized = first.filter(F.col("size").isNotNull() & (F.col("size") > 0) & F.col("colour").isNotNull())
    digits = F.pow(F.lit(10.0), F.floor(F.log10("size")) - 3)
    likes = sized.withColumn("size", F.round(F.col("size") / digits) * digits).select("listing", "part", "gtin", "size", "dimension", "colour", "pack", F.explode("words").alias("word"))
    likes = likes.filter(~F.col("word").isin(colours))
    series = series_words(likes.select("word"), settled.filter("kind = 'word'"), one_brand)
    if names is not None:
        series = series.join(names.select("word").distinct(), "word", "left_anti")
    likes = cut_lineage(likes.join(series, "word"))
    group = ["word", "colour", "pack", "dimension"]
    likes = likes.join(same_sizes(likes, group, rounding), [*group, "size"])
    by_like = likes.select("listing", F.concat_ws("/", F.lit("like:"), "word", "colour", "pack", "dimension", F.col("size0").cast("string")).alias("key"), F.col("part").alias("w1"), F.col("gtin").alias("w2"), none.alias("w3"))
    return guarded(cut_lineage(by_gtin.unionByName(by_part).unionByName(by_like)), "w1", "w2", "w3")


def label_listings(listings: DataFrame, rounding: float = ROUNDING, one_brand: float = ONE_BRAND, names: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """(listing, product): of (listing, title, body, brand) each listing that has a key, with its product's label.

    ``more`` are further keys (listing, key) that listings share, taken as they are. Nulls in any column, empty and very
    long texts are listings without that evidence; a listing without any key has no row.
    """
    keys = listing_keys(listings, rounding, one_brand, names)
    keys = cut_lineage(keys.unionByName(more) if more is not None else keys)
    of = keys.groupBy("listing").agg(F.min("key").alias("_first"))
    edges = keys.join(of, "listing").select(F.col("key").alias("a"), F.col("_first").alias("b")).distinct()
    product = components(edges)
    return of.join(product, F.col("_first") == F.col("node")).select("listing", F.col("component").alias("product"))


def _listings(walmart: DataFrame, amazon: DataFrame) -> DataFrame:
    text = lambda df, c: F.array_join(c, " ") if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(c)
    a = amazon.select(F.concat(F.lit("amazon:"), "row_id").alias("listing"), "title", text(amazon, "description").alias("body"), F.col("brand").alias("vendor"))
    w = walmart.select(F.concat(F.lit("walmart:"), "item_id").alias("listing"), "title", F.lit(None).cast("string").alias("body"), F.col("brand").alias("vendor"))
    return a.unionByName(w)


def product_groups(walmart: DataFrame, amazon: DataFrame) -> DataFrame:
    """(listing, product) over both tables; a listing key is ``amazon:<row_id>`` or ``walmart:<item_id>``.

    Copies in layout of an amazon listing are of its product, and of one of their own where nothing else names one. A
    listing without any evidence is a product of its own.
    """
    both = _listings(walmart, amazon)
    turned = F.when(F.contains("_c", F.lit(",")), F.concat_ws(" ", F.split_part("_c", F.lit(","), F.lit(2)), F.split_part("_c", F.lit(","), F.lit(1)))).otherwise(F.col("_c"))
    typed = both.withColumn("_c", F.expr(clean_sql("vendor"))).withColumn("_c", F.trim(turned))
    listings = typed.select("listing", "title", "body", F.when((F.col("_c") != "") & ~F.col("_c").isin(*NO_BRAND), F.col("_c")).alias("brand"))
    names = listings.select(F.explode(F.split("brand", r"[^\p{L}]+")).alias("word")).filter(F.length("word") >= 4)
    copies = copy_members(amazon).select(F.concat(F.lit("amazon:"), "row_id").alias("listing"), F.concat(F.lit("copy:"), "gid").alias("key"))
    told = label_listings(listings, names=names, more=copies)
    alone = both.select("listing").join(told.select("listing"), "listing", "left_anti").select("listing", F.concat(F.lit("only:"), "listing").alias("product"))
    return told.unionByName(alone)


def product_members(groups: DataFrame) -> DataFrame:
    """(listing, product, n_listings): the product as the least of its listings, and how many it has."""
    of = groups.groupBy("product").agg(F.min("listing").alias("_rep"), F.count("*").alias("n_listings"))
    return groups.join(of, "product").select("listing", F.col("_rep").alias("product"), "n_listings")


def product_pairs(groups: DataFrame) -> DataFrame:
    """(listing_a, listing_b): all pairs of listings of one product, the smaller key first."""
    a, b = groups.select("product", F.col("listing").alias("listing_a")), groups.select("product", F.col("listing").alias("listing_b"))
    return a.join(b, "product").filter(F.col("listing_a") < F.col("listing_b")).select("listing_a", "listing_b")
