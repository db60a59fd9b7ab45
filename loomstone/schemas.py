"""Declared schemas of the catalogue tables, so that nothing is inferred from JSON or CSV."""

from pyspark.sql import types as T

RAW = T.StructType(
    [
        T.StructField("asin", T.StringType()),
        T.StructField("description", T.ArrayType(T.StringType())),
        T.StructField("title", T.StringType()),
        T.StructField("feature", T.ArrayType(T.StringType())),
        T.StructField("brand", T.StringType()),
        T.StructField("main_cat", T.StringType()),
    ]
)
RETAIL = T.StructType([T.StructField(c, T.StringType()) for c in ("Product Name", "Category", "Description", "Brand")])
CACHE = T.StructType([T.StructField("asin", T.StringType()), T.StructField("lang", T.StringType())])
