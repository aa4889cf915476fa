"""Rows that a loader has left in a table of unknown shape: unwrap their payload, map it, keep their order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.mappers import mapper

# Where a payload may lie.
LEGACY = "_airbyte_data"
EXTRACTED_AT = "_airbyte_extracted_at"
NESTED = ["data", "item", "record", "payload", "json"]
IMPORT_LIMIT = 500

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _filled_object(value: Column) -> Column:
    """JSON text of a non-empty object, else null."""
    keys = F.json_object_keys(F.when(F.ltrim(value).startswith("{") & F.try_parse_json(value).isNotNull(), value))
    return F.when(F.size(keys) > 0, value)


def payload(row: Column) -> Column:
    """The payload of a staging row given as JSON text: a wrapped object if there is one, else the row."""
    inner = [_filled_object(F.get_json_object(row, f"$.{k}")) for k in [LEGACY, *NESTED]]
    return F.coalesce(*inner, row)


def safe_table(name: str, schema: str = "staging") -> str:
    """A one- or two-part table name of plain identifiers."""
    parts = name.split(".") if "." in name else [schema, name]
    if len(parts) != 2 or not all(_NAME.fullmatch(p) for p in parts):
        raise ValueError(f"unsafe table name: {name}")
    return ".".join(parts)


def read_staging(spark: SparkSession, name: str, limit: int = IMPORT_LIMIT) -> DataFrame | None:
    """The newest `limit` rows as JSON text in `row`, with their order in `seq`; None for a missing table."""
    full = safe_table(name)
    if not spark.catalog.tableExists(full):
        return None
    return newest(spark.table(full), limit)


def newest(staged: DataFrame, limit: int = IMPORT_LIMIT) -> DataFrame:
    """The limit is the feature: an import takes the newest rows only, those without a time first."""
    order = [F.desc_nulls_first(EXTRACTED_AT)] if EXTRACTED_AT in staged.columns else []
    rows = staged.select(F.to_json(F.struct(*staged.columns)).alias("row"), *([EXTRACTED_AT] if order else []))
    rows = rows.orderBy(*order, "row").limit(limit) if order else rows.limit(limit)
    # row numbers of at most `limit` rows
    return rows.withColumn("seq", F.monotonically_increasing_id()).select("seq", "row")


def import_rows(rows: DataFrame, brand: str, source: str, mapper_name: str | None = None) -> DataFrame:
    """Records of staging rows (column `row`)."""
    items = rows.select(F.lit(brand).alias("brand"), F.lit(source).alias("source"), payload(F.col("row")).alias("item"))
    return mapper(mapper_name, source)(items)
