"""Merkle fixity audit of web archives: two replicas are compared from the roots down.

Records lie in archive files at byte offsets. A leaf commits to a record's digest and its offset range,
an inner node to its children in order and the range they span. Files have a tree each, and the file
roots form one more tree. The audit compares roots and reads only children of nodes that differ.

Cases: a null url or html counts as empty; records without page_id get a file by hash of their bytes;
repeated rows are records of their own; ties go by record digest; an empty replica leaves every record
missing, an empty primary every record extra; two empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import persist

FILE_RECORDS = 512
FAN = 8


def record(page_id: Column, url: Column, html: Column) -> Column:
    """One WARC/1.1 response record as text."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def archive(pages: DataFrame, with_record: bool = False) -> DataFrame:
    """(page_id, file, record_no, start, length, digest[, record]): where each page's record lies."""
    made = pages.select("page_id", record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    rows = made.select(
        "page_id",
        F.floor(F.coalesce("page_id", F.pmod(F.xxhash64("record"), F.lit(1 << 40))) / FILE_RECORDS).cast("long").alias("file"),
        F.octet_length("record").cast("long").alias("length"),
        F.sha2("record", 256).alias("digest"),
        *(["record"] if with_record else []),
    )
    order = Window.partitionBy("file").orderBy("page_id", "digest")
    return rows.withColumn("record_no", F.row_number().over(order) - 1).withColumn(
        "start", F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    )


def tree(leaves: DataFrame, records: int, files: int) -> tuple[list[DataFrame], int]:
    """Levels of nodes (file, idx, start, stop, hash) from leaves to one root, and how many lie inside files.

    `records` (of the largest file) and `files` set the height, so that replicas get trees of equal
    height. Above the file roots `file` is -1 and idx is the file's number.
    """
    stop = F.col("start") + F.col("length")
    levels = [leaves.select("file", F.col("record_no").cast("long").alias("idx"), "start", stop.alias("stop"), _hash("leaf", F.col("digest"), F.col("start"), stop))]
    while records > 1:
        levels.append(persist(_up(levels[-1]), "merkle"))
        records = -(-records // FAN)
    inner = len(levels)
    levels.append(levels[-1].select(F.lit(-1).cast("long").alias("file"), F.col("file").alias("idx"), "start", "stop", "hash"))
    while files > 1:
        levels.append(persist(_up(levels[-1]), "merkle"))
        files = -(-files // FAN)
    return levels, inner


def _hash(kind: str, digest: Column, start: Column, stop: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(kind), digest, start, stop), 256).alias("hash")


def _up(level: DataFrame) -> DataFrame:
    """Parents of a level; a parent lists at most FAN children."""
    kids = level.groupBy("file", F.floor(F.col("idx") / FAN).cast("long").alias("idx")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "start", "stop", "hash"))).alias("kids")
    )
    start, stop = F.col("kids")[0]["start"], F.element_at("kids", -1)["stop"]
    return kids.select("file", "idx", start.alias("start"), stop.alias("stop"), _hash("node", F.array_join(F.transform("kids", lambda k: k["hash"]), ","), start, stop))


def _differ(a: DataFrame, b: DataFrame, within: DataFrame | None, crossing: bool) -> DataFrame:
    """(file, idx) of nodes that differ, among children of the nodes in `within`."""
    if within is not None:
        key = [F.col("idx").alias("file")] if crossing else ["file", F.col("idx").alias("up")]
        on = within.select(*key)
        a, b = ((x if crossing else x.withColumn("up", F.floor(F.col("idx") / FAN).cast("long"))).join(on, ["file"] if crossing else ["file", "up"], "left_semi") for x in (a, b))
    left, right = a.select("file", "idx", F.col("hash").alias("h")), b.select("file", "idx", F.col("hash").alias("g"))
    return left.join(right, ["file", "idx"], "full").where(~F.col("h").eqNullSafe(F.col("g"))).select("file", "idx")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(page_id, file, record_no, start, length, digest, status) of every record of either replica.

    status: ok, corrupt (other bytes), moved (same bytes at another offset), missing (not in the
    replica) or extra (only there). Only files in which the descent found a differing leaf are compared
    record by record; all others are ok by their roots.
    """
    primary, replica = persist(primary, "archive"), persist(replica, "archive")
    most = primary.select("record_no", "file").unionAll(replica.select("record_no", "file")).agg(F.max("record_no"), F.max("file")).first()
    size = (most[0] or 0) + 1, (most[1] or 0) + 1
    (one, inner), (two, _) = tree(primary, *size), tree(replica, *size)
    found: DataFrame | None = None
    columns = ["page_id", "file", "record_no", "start", "length", "digest"]
    for level in range(len(one) - 1, -1, -1):
        found = persist(_differ(one[level], two[level], found, level == inner - 1), "differ")
        if found.isEmpty():
            return primary.select(*columns, F.lit("ok").alias("status"))
    bad = found.select("file").distinct()
    good = primary.join(bad, "file", "left_anti").select(*columns, F.lit("ok").alias("status"))
    place = Window.partitionBy("file", "page_id").orderBy("digest", "start")
    left = primary.join(bad, "file", "left_semi").withColumn("nth", F.row_number().over(place))
    right = replica.join(bad, "file", "left_semi").withColumn("nth", F.row_number().over(place))
    a, b = left.alias("a"), right.alias("b")
    same = F.col("a.file").eqNullSafe(F.col("b.file")) & F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.nth") == F.col("b.nth"))
    status = (
        F.when(F.col("b.digest").isNull(), "missing")
        .when(F.col("a.digest").isNull(), "extra")
        .when(F.col("a.digest") != F.col("b.digest"), "corrupt")
        .when(F.col("a.start") != F.col("b.start"), "moved")
        .otherwise("ok")
    )
    matched = a.join(b, same, "full").select(*[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in columns], status.alias("status"))
    return good.unionAll(matched)


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with planted faults, by page_id: a changed first byte, a lost tail, a lost record."""
    html = F.coalesce("html", F.lit(""))
    changed = (
        F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("#"), F.substring(html, 2, 1 << 30)))
        .when(F.col("page_id") % 389 == 11, F.substring(html, 1, 100))
        .otherwise(F.col("html"))
    )
    return pages.where(F.col("page_id").isNull() | (F.col("page_id") % 193 != 7)).select("page_id", "url", changed.alias("html"))
