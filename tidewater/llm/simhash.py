"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then Hamming distance.

Two forms: `link_fingerprints` links 64-bit fingerprints at a small distance and loses no link;
`near_duplicates` groups documents whose five-word shingles are alike (0.8 or more): at that similarity
SimHashes differ in ten of 64 bits and no pigeonhole blocks of them are selective, so blocks are cut from
min-hashes, SimHash rules pairs out and the shingle sets decide.

Cases: a null text counts as empty; texts without words have fingerprint zero and link to each other;
a null doc_id takes part but never names a group unless the group has no other; repeated rows share
a fingerprint and a group; an empty table gives no rows; long texts are read in slices; other columns
are kept by `keep_one` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.buckets import band_sets, rest_sets
from tidewater.llm.common import Memo, components, forest, mix64, near, persist, texts

SEED = 42
#: Fingerprints of one bucket that one task compares at once; larger buckets take the exact other way.
BUCKET = 256


def fingerprint(raw: bytes, words_per_shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of UTF-8 text, as a signed long.

    A-Z is lowered; words end at the ASCII white space that bytes.split knows (0x20, 0x09 to 0x0D).
    """
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(words_per_shingle, len(words))
    first, last = starts[: len(words) - k + 1], ends[k - 1 :]
    digest = xxhash.xxh64_digest
    count = np.zeros(64, np.int64)
    for s in range(0, len(first), 65_536):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(first[s : s + 65_536].tolist(), last[s : s + 65_536].tolist(), strict=True)])
        rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
        for r in range(0, len(rows), 255):
            count += np.add.reduce(np.unpackbits(rows[r : r + 255], axis=1), axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * count > len(first)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, words_per_shingle) for x in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks over all choices of blocks - distance blocks of a 64-bit word, as signed longs."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    full = [sum(choice) for choice in combinations(single, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in full]


def block_keys(prints: DataFrame, masks: list[int]) -> DataFrame:
    """(k, key, fp): one row for each choice of blocks; words at `distance` share at least one (k, key)."""
    every = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
    return prints.select("fp", F.explode(every).alias("e")).select("e.k", "e.key", "fp")


def link_fingerprints(prints: DataFrame, distance: int = 2, blocks: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct 64-bit words fp at `distance` or fewer bits.

    Words are cut into `blocks` blocks; close words share one of the choices of blocks - distance blocks.
    Buckets of up to `bucket` words are compared in one task, which returns a spanning forest instead of
    all pairs. Larger buckets go by midpoints: words at distance 2 both lie one bit from a common word,
    so each word is sent to itself and its neighbours in the bucket's free bits, at most 65 meet at
    one midpoint, and these are close to each other by construction. Rows grow in proportion to words.
    """
    if distance > 2:
        raise ValueError("large buckets are exact for distances up to 2")
    masks = block_masks(distance, blocks)
    keyed = block_keys(prints, masks)
    sizes = keyed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = persist(keyed.join(sizes, ["k", "key"]), "blocks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for words in batch.column("words").to_pylist():
                lanes = np.array(words, np.int64)
                pairs = near(lanes.view(np.uint64)[:, None], distance)
                pairs = forest(pairs, len(lanes))
                a.append(lanes[pairs[:, 0]])
                b.append(lanes[pairs[:, 1]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    small = shared.where(F.col("n") <= bucket).groupBy("k", "key").agg(F.array_sort(F.collect_list("fp")).alias("words"))
    edges = small.select("words").mapInArrow(compare, "a long, b long")
    flips = [[0] + [v - (1 << 64) if (v := 1 << i) >> 63 else v for i in range(64) if not m >> i & 1] for m in masks]
    turned = F.element_at(F.array(*[F.array(*map(F.lit, f)) for f in flips]), F.col("k") + 1)
    met = (
        shared.where(F.col("n") > bucket)
        .select("k", "fp", F.explode(F.transform(turned, lambda m: F.col("fp").bitwiseXOR(m))).alias("mid"))
        .groupBy("k", "mid")
        .agg(F.collect_set("fp").alias("words"))
        .where(F.size("words") > 1)
    )
    hot = met.select(F.array_min("words").alias("a"), F.explode("words").alias("b")).where("a <> b")
    return edges.unionAll(hot).distinct()


def group_documents(docs: DataFrame, distance: int = 2, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id reachable over links."""
    marked = persist(fingerprints(docs, words_per_shingle), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("lead"))
    groups = components(link_fingerprints(distinct.select("fp"), distance), "simhash")
    # one row for each fingerprint: its group's smallest doc_id
    rooted = persist(distinct.join(groups, distinct.fp == groups.node, "left").select("fp", "lead", F.coalesce("root", "fp").alias("root")), "rooted")
    leads = rooted.groupBy("root").agg(F.min("lead").alias("component_id"))
    named = rooted.select("fp", "root").join(leads, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- documents alike in 0.8 or more of their five-word shingles

SHINGLE = 5
SIMILARITY = 0.8
#: Documents meet on bands of min-hashes over shingles: (1 - 0.8 ** BAND) ** BANDS = 0.3 % of links at 0.8 are missed, at every table size.
BAND, BANDS = 3, 8
#: Most bits in which SimHashes of two alike documents differ: at 0.8, 10 of 64 with a deviation of 3.
LANE_BITS = 26
#: Column beside those of the input while `keep_one` works.
ROW = "__alike_row"


def shingle_set(words: list[bytes], known: Memo) -> np.ndarray:
    """Sorted hashes of the distinct five-word shingles; of fewer words, of the whole sequence."""
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(h))
    out = np.zeros(len(h) - k + 1 if k else 0, np.uint64)
    for j in range(k):
        out = mix64(out * np.uint64(31) + h[j : len(out) + j])
    return np.unique(out)


def set_print(shingles: np.ndarray) -> int:
    """SimHash of a set of shingles, as a signed long."""
    above = np.zeros(64, np.int64)
    rows = shingles.astype(">u8").view(np.uint8).reshape(-1, 8)
    for s in range(0, len(rows), 4080):
        bits = np.unpackbits(rows[s : s + 4080], axis=1)
        above += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * above > len(rows)).tobytes(), "big", signed=True)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One long for each band: its min-hashes and its number, hashed."""
    steps = (np.arange(1, BAND * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    least = np.full(BAND * BANDS, np.uint64(2**64 - 1))
    for s in range(0, len(shingles), 4096):
        least = np.minimum(least, mix64(shingles[None, s : s + 4096] + steps).min(1))
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, BAND).T:
        key = mix64(key * np.uint64(31) + part)
    return key.view(np.int64)


def word_memo() -> Memo:
    return Memo(lambda w: xxhash.xxh64_intdigest(w, SEED))


def marks(docs: DataFrame) -> DataFrame:
    """(row, doc_id, id, print): `id` is a hash of the document's shingle set, `print` its SimHash and bands (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_memo()
        for batch in batches:
            sets = [shingle_set(raw.lower().split(), known) for raw in texts(batch.column("text"))]
            ids = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).astype(np.int64)
            found = pa.array([np.concatenate([[set_print(x)], band_keys(x)]) if len(x) else None for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(ids), found], ["row", "doc_id", "id", "print"])

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, id long, print array<long>")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values every two sets of distinct values share."""
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of, at = of[times[at] > 1], (np.cumsum(times > 1) - 1)[at[times[at] > 1]]
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    both = np.zeros((len(sets), len(sets)))
    for s in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        low, high = np.searchsorted(at, [s, s + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[of[low:high], at[low:high] - s] = 1
        both += part @ part.T
    return both


def _alike(sets: DataFrame, place: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges (a, b) between alike shingle sets of `sets`: place is (id, row) of each, rows hold (row, text)."""
    met = persist(sets.select(F.xxhash64("members").alias("set"), "members"), "met").select("set", F.explode("members").alias("id"))
    wanted = met.select("id").distinct().join(place, "id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_memo()
        for batch in batches:
            # half of a hash is enough to compare two sets
            held = [np.unique((shingle_set(raw.lower().split(), known) >> np.uint64(32)).astype(np.uint32)).tobytes() for raw in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(held, pa.binary())], ["id", "held"])

    held = wanted.join(rows.select("row", "text"), "row").select("id", "text").mapInArrow(read, "id long, held binary")
    whole = met.join(held, "id").groupBy("set").agg(F.collect_list(F.struct("id", "held")).alias("members"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column("members"):
                got = members.values
                ids = got.field("id").to_numpy(zero_copy_only=False)
                sets = [np.frombuffer(x, np.uint32) for x in got.field("held").to_pylist()]
                size = np.array([len(x) for x in sets])
                both = common_counts(sets)
                alike = both >= SIMILARITY * (size[:, None] + size[None, :] - both) - 1e-9
                pairs = forest(np.argwhere(np.triu(alike, 1)), len(ids))
                a.append(ids[pairs[:, 0]])
                b.append(ids[pairs[:, 1]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return whole.select("members").mapInArrow(compare, "a long, b long").distinct()


def _alike_groups(docs: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, id) of all rows, and (id, root, lead) of all shingle sets: `lead` is the group's first (doc_id, row), null last."""
    rows = docs.select(F.xxhash64("doc_id", F.xxhash64("text")).alias("row"), "doc_id", "text")
    marked = persist(marks(rows), "marks")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    prints = persist(marked.groupBy("id").agg(F.min(first).alias("lead"), F.min("print").alias("print")), "prints")
    place = prints.select("id", F.col("lead.row").alias("row"))
    # documents that meet in several bands are compared once
    sets, chunks = band_sets(prints.where("print is not null").select("id", "print"), BANDS * prints.count(), LANE_BITS, bucket)
    edges = _alike(sets, place, rows)
    if not chunks.isEmpty():
        edges = persist(edges, "alike")
        edges = edges.unionAll(_alike(rest_sets(chunks, components(edges, "alike"), LANE_BITS), place, rows))
    groups = components(edges, "alike")
    rooted = persist(prints.select("id", "lead").join(groups, F.col("id") == F.col("node"), "left").select("id", "lead", F.coalesce("root", "id").alias("root")), "alike-rooted")
    leads = rooted.groupBy("root").agg(F.min("lead").alias("lead"))
    return marked.select("row", "doc_id", "id"), rooted.select("id", "root").join(leads, "root")


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, component_id) of all documents; alone, a document is its own component.

    Documents with equal shingle sets count once. The others meet on bands of min-hashes and link if the
    Jaccard similarity of their shingle sets is 0.8 or more. Buckets above `bucket` meet as `band_sets` and `rest_sets` say:
    no two near ones of a bucket are left out.
    """
    marked, groups = _alike_groups(docs, bucket)
    return marked.join(groups, "id").select("doc_id", F.col("lead.doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each near-duplicate group, keep the row with the smallest doc_id, null last; columns stay as they are.

    Rows are told apart by doc_id and text, so a doc_id may lose one text and keep another; rows that
    repeat the kept one in both all stay.
    """
    marked, groups = _alike_groups(docs, BUCKET)
    drop = marked.join(groups, "id").where(F.col("row") != F.col("lead.row")).select(F.col("row").alias(ROW)).distinct()
    return docs.withColumn(ROW, F.xxhash64("doc_id", F.xxhash64("text"))).join(drop, ROW, "left_anti").select(docs.columns)
