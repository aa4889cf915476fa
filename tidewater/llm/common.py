"""Helpers that several corpus operators share: scratch tables, ranks, groups, bucketed links."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCRATCH: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only a local session without one gets its own."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewater-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


#: Spark's own setting for shuffle files to go as soon as the query that wrote them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def persist(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it back: cuts lineage, survives executors.

    Shuffle files of the write go when it ends: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    SCRATCH.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the scratch tables made from number `since` on, but for the newest `keep`: what was written meanwhile doesn't need them."""
    jvm = spark._jvm
    going = SCRATCH[since : len(SCRATCH) - keep]
    del SCRATCH[since : len(SCRATCH) - keep]
    for name in going:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str, rows: int, per_bucket: int = 2000) -> DataFrame:
    """Gapless rank from 0 within keys, without one task per key.

    Rows are dealt into hash buckets of about per_bucket rows; the rank is the bucket's offset
    (a running sum over the small table of bucket sizes) plus the row number inside the bucket.
    Only the order inside a bucket follows `order`; identical rows rank in any order.
    """
    n = max(1, min(1_000_000, -(-rows // per_bucket)))
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    sizes = dealt.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    running = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(running), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    return (
        dealt.withColumn("_rn", F.row_number().over(inside) - 1)
        .join(starts, [*keys, "_b"])
        .withColumn(out, F.col("_start") + F.col("_rn"))
        .drop("_b", "_rn", "_start")
    )


def components(edges: DataFrame, label: str, rounds: int = 60) -> DataFrame:
    """Connected groups of the edges (a, b): rows (node, root), root the smallest node of its group.

    Alternating large-star and small-star steps (Kiveris et al. 2014); each round is written to the
    scratch folder. Mins are aggregated before the shuffle, so hubs cost no more than their rows.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = persist(e, label)
    for _ in range(rounds):
        if not _unfinished(e):
            break
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = persist(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), label)
    else:
        raise RuntimeError(f"groups did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


def _unfinished(e: DataFrame) -> bool:
    """Stars are final when every node points to one root and no root points on."""
    forked = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    onward = e.join(e.select(F.col("v").alias("u")), "u", "left_semi").select("u")
    return not forked.unionAll(onward).isEmpty()


def forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """Of index pairs below n, those that join two groups not joined before: at most n - 1."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for i, j in pairs.tolist():
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((i, j))
    return np.array(kept, np.int64).reshape(-1, 2)


def near(prints: np.ndarray, most: int, others: np.ndarray | None = None) -> np.ndarray:
    """Index pairs of rows of uint64 lanes at no more than `most` differing bits."""
    same = others is None
    others = prints if same else others
    found = []
    for s in range(0, len(prints), 256):
        part = prints[s : s + 256]
        bits = np.zeros((len(part), len(others)), np.uint16)
        for lane in range(prints.shape[1]):
            bits += np.bitwise_count(part[:, lane, None] ^ others[None, :, lane])
        i, j = np.nonzero(bits <= most)
        i = i + s
        if same:
            i, j = i[i < j], j[i < j]
        found.append(np.stack([i, j], 1))
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def least_positions(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every window of `width` hashes, where its least one lies (by the upper 48 bits, the first of equals)."""
    total = len(hashes) - width + 1
    at = np.empty(max(0, total), np.int64)
    low = np.uint64(0xFFFF)
    for s in range(0, total, 32_768):
        part = hashes[s : min(s + 32_768, total) + width - 1]
        part = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            part = np.minimum(part[:-span], part[span:])
            span *= 2
        if width > span:
            part = np.minimum(part[: len(part) - (width - span)], part[width - span :])
        at[s : s + len(part)] = (part & low).astype(np.int64) + s
    return at


class Memo(dict):
    """Values of f by key, forgotten all at once beyond `most` keys, so that memory stays bounded."""

    def __init__(self, f, most: int = 400_000):
        self.f, self.most = f, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.f(key)
        return value


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]
