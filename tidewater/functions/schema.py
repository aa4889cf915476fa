"""The one record that every source is mapped to, and its content key."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("brand", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("source_url", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("text", T.StringType(), False),
        T.StructField("created_at", T.StringType()),
        T.StructField("captured_at", T.StringType()),
        T.StructField("extra", T.StringType()),
    ]
)

SERVED_SCHEMA = T.StructType(
    [
        *[f for f in RAW_SCHEMA if f.name != "extra"],
        T.StructField("sentiment", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("relevant", T.BooleanType()),
        T.StructField("qc_checked", T.BooleanType()),
    ]
)


def content_key(brand: Column, source: Column, url: Column, text: Column) -> Column:
    """SHA-256 of brand, source, url and text, joined by a bar; an absent part reads None."""
    parts = [x for c in (brand, source, url, text) for x in (F.lit("|"), F.coalesce(c, F.lit("None")))]
    return F.sha2(F.concat(*parts[1:]), 256)
