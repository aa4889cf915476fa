"""Sets of rows that share a band key: a join of a table with itself on many keys, in memory and rows that stay bounded.

Rows of one key are a bucket. Keys are dealt and sorted once, and a task reads its buckets as a stream, so
it never holds more than one batch and one chunk. Buckets of up to `bucket` rows leave whole. Larger ones leave in
chunks, in the order of their fingerprints, and each chunk takes along the same few leading rows of its
bucket, so that all rows of a large group of copies meet in them; rows of large buckets also meet by key
and one further key, in TURNS ways, so that small groups inside a large bucket meet as well. That much grows
in proportion to rows. What it may miss, `rest_sets` finds: every two chunks of a large bucket meet, for the rows
that verified links have not connected by then. Fingerprints are compared a chunk with a chunk, dealt over all tasks;
that work is quadratic in the rows of a large bucket that stay apart, and in nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import forest, near, persist

#: Rows of one bucket that meet each other at once.
BUCKET = 256
#: Rows of a large bucket that all its chunks meet, and further keys by which its rows meet.
LEADING, TURNS = 32, 2
#: Keys of one task.
TASK_KEYS = 1_000_000


def band_sets(prints: DataFrame, keys: int, most: int, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(members): sets of ids, each connected by a shared key and fingerprints at `most` or fewer differing bits;
    and the chunks of large buckets, for `rest_sets`.

    prints: (id, print), `print` an array of a 64-bit fingerprint and then the same number of keys in each
    row, about `keys` in all; rows may repeat. Equal sets come once.
    """
    found = persist(_streamed(_keyed(prints), keys, most, bucket), "buckets")
    sets = _whole(found, most)
    hot = found.where("chunk >= 0").select("key", F.explode("ids").alias("id"))
    if not hot.isEmpty():
        held = F.slice("print", 2, F.size("print") - 1)
        # the key itself is one of the row's keys: those after it take turns
        at = F.array_position(held, F.col("key"))
        turns = F.array(*[F.xxhash64("key", F.element_at(held, (F.pmod(at - 1 + t, F.size(held)) + 1).cast("int"))) for t in range(1, TURNS + 1)])
        again = hot.distinct().join(prints, "id").select("id", F.element_at("print", 1).alias("p"), F.explode(turns).alias("key")).select("key", "id", "p")
        deeper = persist(_streamed(again, keys, most, bucket), "buckets")
        sets = sets.unionAll(_whole(deeper, most))
    sets = sets.select(F.array_sort("members").alias("members"))
    return sets.withColumn("set", F.xxhash64("members")).dropDuplicates(["set"]).select("members"), found.where("chunk >= 0")


def rest_sets(chunks: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """(members, p, root): sets in which all ids of one large bucket meet that are near and not in one group yet; with each
    member's fingerprint (turned alike within a set) and group.

    chunks: as `band_sets` gives them; groups: (node, root) of ids that verified links connect, others are alone.
    """
    if chunks.isEmpty():
        return chunks.select(F.col("ids").alias("members"), "p", F.col("ids").alias("root"))
    rows = chunks.select("key", "chunk", F.explode(F.arrays_zip("ids", "p")).alias("x")).select("key", "chunk", F.col("x.ids").alias("id"), F.col("x.p").alias("p"))
    rooted = rows.join(groups, F.col("id") == F.col("node"), "left").select("key", "chunk", "id", "p", F.coalesce("root", "id").alias("root"))
    held = persist(rooted.groupBy("key", "chunk").agg(*[F.collect_list(F.struct("id", "p", "root")).alias("rows"), F.min("root").alias("low"), F.max("root").alias("high")]), "bucket-chunks")
    apart = held.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("chunk").alias("last")).where("low <> high").select("key", "last")
    each = held.join(apart, "key").withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    met = each.groupBy("key", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b")).agg(F.collect_list("rows").alias("sides"), F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sides in batch.column("sides"):
                parts = [[x.values.field(c).to_numpy() for c in ("id", "p", "root")] for x in (sides.values[k] for k in range(len(sides)))]
                (one, p, r), (two, q, s) = parts[0], parts[-1]  # a chunk alone meets itself
                near = (np.bitwise_count((p[:, None] ^ q[None, :]).view(np.uint64)) <= most) & (r[:, None] != s[None, :])
                here, there = near.any(1), near.any(0)
                members, at = np.unique(np.concatenate([one[here], two[there]]), return_index=True)
                if len(members):
                    held = [members, np.concatenate([p[here], q[there]])[at], np.concatenate([r[here], s[there]])[at]]
                    yield pa.RecordBatch.from_arrays([_lists([x]) for x in held], ["members", "p", "root"])

    sets = met.select("sides").mapInArrow(compare, "members array<long>, p array<long>, root array<long>")
    return sets.withColumn("set", F.xxhash64("members")).dropDuplicates(["set"]).drop("set")


def rest_fits(chunks: DataFrame, groups: DataFrame, marks: DataFrame, most: int, similarity: float, common: float) -> DataFrame:
    """`rest_sets` for rows with marks (id, size, bins) that rule pairs out: the smaller size is at least `similarity` of the larger one,
    and the bins (a byte each, 255 for any more) have at least `common` of it in common.

    Rows of a bucket meet in cells of like size, each with itself and the next one, in chunks of up to BUCKET rows. What leaves
    grows with the pairs that fit, not with those that are compared.
    """
    rows = chunks.select("key", F.explode(F.arrays_zip("ids", "p")).alias("x")).select("key", F.col("x.ids").alias("id"), F.col("x.p").alias("p"))
    rooted = rows.join(groups, F.col("id") == F.col("node"), "left").select("key", "id", "p", F.coalesce("root", "id").alias("root")).join(marks, "id")
    # a hair wider than 1 / similarity, so that sizes that fit are never two cells apart
    celled = persist(rooted.withColumn("cell", F.floor(F.log(F.col("size") + 1) / math.log(1.0001 / similarity)).cast("int")), "bucket-rows")
    many = celled.groupBy("key", "cell").agg(F.ceil(F.count("*") / BUCKET).alias("chunks"))
    placed = celled.join(many, ["key", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int"))
    held = persist(placed.groupBy("key", "cell", "chunk").agg(F.collect_list(F.struct("id", "p", "root", "size", "bins")).alias("rows"), F.min("root").alias("low"), F.max("root").alias("high")), "bucket-chunks")
    names = held.select("key", "cell", "chunk", "low", "high")
    other = names.select("key", *[F.col(c).alias(f"other_{c}") for c in names.columns[1:]])
    beside = ((F.col("other_cell") == F.col("cell")) & (F.col("other_chunk") >= F.col("chunk"))) | (F.col("other_cell") == F.col("cell") + 1)
    met = names.join(other, "key").where(beside & (F.least("low", "other_low") < F.greatest("high", "other_high"))).drop("low", "high", "other_low", "other_high")
    sides = held.select("key", *[F.col(c).alias(f"other_{c}") for c in ("cell", "chunk", "rows")])
    met = met.join(held, ["key", "cell", "chunk"]).join(sides, ["key", "other_cell", "other_chunk"]).select("rows", "other_rows", (F.struct("cell", "chunk") == F.struct("other_cell", "other_chunk")).alias("alone"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two, alone in zip(batch.column("rows"), batch.column("other_rows"), batch.column("alone").to_pylist(), strict=True):
                (a, p, r, m, u), (b, q, s, n, v) = (_fields(x) for x in (one, two))
                longer = np.maximum(m[:, None], n[None, :])
                near = (np.bitwise_count((p[:, None] ^ q[None, :]).view(np.uint64)) <= most) & (r[:, None] != s[None, :])
                near &= np.abs(m[:, None] - n[None, :]) <= (1 - similarity) * longer + 1e-9
                i, j = np.nonzero(np.triu(near, 1) if alone else near)
                ok = np.zeros(len(i), bool)
                for k in range(0, len(i), 4096):
                    least = np.minimum(u[i[k : k + 4096]], v[j[k : k + 4096]])
                    # a full bin may hold any number
                    ok[k : k + 4096] = (least.sum(1, dtype=np.int64) >= common * longer[i[k : k + 4096], j[k : k + 4096]]) | (least == 255).any(1)
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                if not alone:
                    a, p, r, j = np.concatenate([a, b]), np.concatenate([p, q]), np.concatenate([r, s]), j + len(a)
                label = np.arange(len(a))
                for x, y in forest(np.stack([i, j], 1), len(a)).tolist():
                    label[label == label[y]] = label[x]
                sets = [np.flatnonzero(label == x) for x in np.unique(label[i])]
                yield pa.RecordBatch.from_arrays([_lists([c[np.sort(g)] for g in sets]) for c in (a, p, r)], ["members", "p", "root"])

    return met.mapInArrow(compare, "members array<long>, p array<long>, root array<long>")


def _fields(rows: pa.ListScalar) -> list[np.ndarray]:
    """Columns of the rows of one chunk; bins as a table of bytes."""
    columns = [rows.values.field(c) for c in ("id", "p", "root", "size", "bins")]
    return [*[c.to_numpy().astype(np.int64) for c in columns[:4]], np.frombuffer(b"".join(columns[4].to_pylist()), np.uint8).reshape(len(columns[4]), -1)]


def _keyed(prints: DataFrame) -> DataFrame:
    """(key, id, p): a row for each key; p is the fingerprint, turned by the key's number so that each key sorts by other bits first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("print")
            rows = lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()].reshape(batch.num_rows, -1)
            width = rows.shape[1] - 1
            turn = (np.arange(width) * 7 % 64).astype(np.uint64)[None, :]
            p = rows[:, :1].copy().view(np.uint64)
            p = (p << turn) | (p >> ((np.uint64(64) - turn) % np.uint64(64)))
            ids = np.repeat(batch.column("id").to_numpy(), width)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 1:].reshape(-1)), pa.array(ids), pa.array(p.reshape(-1).view(np.int64))], ["key", "id", "p"])

    return prints.select("id", "print").mapInArrow(run, "key long, id long, p long")


def _streamed(keyed: DataFrame, keys: int, most: int, bucket: int) -> DataFrame:
    """(key, chunk, ids, p) of buckets of two and more rows; chunk is -1 for whole ones, which are cut into connected sets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 3), np.int64)
        chunk = 0  # chunks of the open bucket that have left
        for batch in chain(batches, [None]):
            out: list[tuple[int, int, np.ndarray]] = []
            if batch is not None:
                held = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in ("key", "id", "p")], 1)])
                held = held[np.concatenate([[True], (held[1:] != held[:-1]).any(1)])] if len(held) else held  # repeats lie side by side
            cuts = np.concatenate([[0], np.flatnonzero(held[1:, 0] != held[:-1, 0]) + 1, [len(held)]])
            if batch is not None:
                cuts = cuts[:-1]  # the last bucket may go on
            if chunk and len(cuts) > 1:  # the first bucket has chunks outside already
                out += [(int(held[0, 0]), chunk + k, held[s : min(cuts[1], s + bucket)]) for k, s in enumerate(range(0, cuts[1], bucket))]
                cuts, chunk = cuts[1:], 0
            size = np.diff(cuts)
            two = cuts[:-1][size == 2]
            two = two[np.bitwise_count((held[two, 2] ^ held[two + 1, 2]).view(np.uint64)) <= most]
            out += [(int(held[a, 0]), -1, held[a : a + 2]) for a in two.tolist()]
            for a, b in zip(cuts[:-1][size > 2].tolist(), cuts[1:][size > 2].tolist(), strict=True):
                if b - a > bucket:
                    out += [(int(held[a, 0]), k, held[s : min(b, s + bucket)]) for k, s in enumerate(range(a, b, bucket))]
                else:
                    out += [(int(held[a, 0]), -1, held[a:b][g]) for g in connected(held[a:b, 2], most)]
            held = held[cuts[-1] :] if batch is not None else held[:0]
            while len(held) > bucket:
                out.append((int(held[0, 0]), chunk, held[:bucket]))
                chunk, held = chunk + 1, held[bucket:]
            for k in range(0, len(out), 2000):
                key, no, rows = zip(*out[k : k + 2000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(no, pa.int32()), *[_lists([x[:, c] for x in rows]) for c in (1, 2)]], ["key", "chunk", "ids", "p"])

    dealt = keyed.repartition(max(12, -(-keys // TASK_KEYS)), "key").sortWithinPartitions("key", "p", "id")
    return dealt.mapInArrow(scan, "key long, chunk int, ids array<long>, p array<long>")


def _whole(found: DataFrame, most: int) -> DataFrame:
    """(members) of whole buckets, and of chunks with the leading rows of their buckets."""
    chunks = found.where("chunk >= 0")
    lead = chunks.where("chunk = 0").select("key", *[F.slice(c, 1, LEADING).alias(f"lead_{c}") for c in ("ids", "p")])
    # the first chunk holds the leading rows itself
    both = lambda c: F.when(F.col("chunk") == 0, F.col(c)).otherwise(F.concat(f"lead_{c}", c)).alias(c)
    met = chunks.join(lead, "key").select(both("ids"), both("p"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, p in zip(batch.column("ids"), batch.column("p"), strict=True):
                ids = ids.values.to_numpy()
                if sets := connected(p.values.to_numpy(), most):
                    yield pa.RecordBatch.from_arrays([_lists([ids[g] for g in sets])], ["members"])

    return found.where("chunk < 0").select(F.col("ids").alias("members")).unionAll(met.mapInArrow(split, "members array<long>"))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)]).astype(np.int32), np.concatenate(parts))


def connected(prints: np.ndarray, most: int) -> list[np.ndarray]:
    """Index sets of two or more that fingerprints at `most` or fewer differing bits connect."""
    bits = np.ascontiguousarray(prints).view(np.uint64)
    if (np.bitwise_count(bits ^ bits[0]) <= most).all():
        return [np.arange(len(bits))]
    pairs = forest(near(bits[:, None], most), len(bits))
    if not len(pairs):
        return []
    label = np.arange(len(bits))
    for i, j in pairs.tolist():
        a, b = label[i], label[j]
        label[label == max(a, b)] = min(a, b)
    return [g for v in np.unique(label[pairs[:, 0]]) if len(g := np.flatnonzero(label == v)) > 1]
