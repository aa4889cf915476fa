"""Ingestion and alerts as Structured Streaming: files in, upserts and notices out.

Each micro-batch runs the batch operators over bucketed tables; a batch takes effect once, also if it is
replayed after a failure at any step. Alert state is a table kept the same way, or keyed state inside the stream.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewater.functions.schema import RAW_SCHEMA, SERVED_SCHEMA
from tidewater.operators import alerts
from tidewater.operators.enrich import Embedder, enriched
from tidewater.operators.store import RAW_UPDATES, SERVED_UPDATES
from tidewater.operators.tables import BucketedTable

log = logging.getLogger(__name__)

POLL = "900 seconds"
STATE_SCHEMA = "key string, brand string"
OUTBOX_SCHEMA = "key string, brand string, kind string, id string, n long, sent boolean, attempts int"
#: A notice is given up after so many failed tries to send it.
MOST_ATTEMPTS = 5


def sequenced(batch: DataFrame) -> DataFrame:
    """Rows in their order of arrival: the batch's own `seq`, or, as far as a micro-batch tells, capture time, then id and a digest of the text."""
    # a text's digest tells as much, and doesn't travel with the row as a second copy of the text
    return batch if "seq" in batch.columns else batch.withColumn("seq", F.struct("captured_at", "id", F.unhex(F.sha2("text", 256)).alias("text")))


class Store:
    """The tables of one deployment under a folder: raw and served reviews, what was alerted, notices to send.

    Each notes up to which version of the table before it it has worked, so that a step that died is made
    up by the next call, from the buckets that changed, and no step takes effect twice.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark = spark
        self.raw = BucketedTable(spark, f"{root}/raw", RAW_SCHEMA, buckets)
        self.served = BucketedTable(spark, f"{root}/served", SERVED_SCHEMA, buckets)
        self.state = BucketedTable(spark, f"{root}/alerted", STATE_SCHEMA, buckets, "key")
        self.outbox = BucketedTable(spark, f"{root}/outbox", OUTBOX_SCHEMA, buckets, "key")


def ingest(store: Store, batch: DataFrame, batch_id: int | None = None, provider: Embedder | None = None) -> None:
    """One cycle: upsert raw, enrich what is pending in the buckets that changed, upsert served.

    A batch id that was taken in before adds nothing to raw; what served still lacks is made up all the same.
    """
    store.raw.upsert(sequenced(batch), RAW_UPDATES, stream="reviews", batch_id=batch_id)
    serve(store, provider)


def serve(store: Store, provider: Embedder | None = None) -> None:
    """Bring served up to the newest version of raw."""
    version, done = store.raw.version(), store.served.manifest()["notes"].get("raw", 0)
    if done < version:
        rows = enriched(*pending_sides(store.raw, store.served, done), provider)
        store.served.upsert(rows, SERVED_UPDATES, notes={"raw": version}, once=True)


def pending_sides(raw: BucketedTable, served: BucketedTable, since: int) -> tuple[DataFrame, DataFrame]:
    """Raw rows written since a version (what was there before was served with it), and the served rows that they may meet."""
    rows = raw.written(since)
    buckets = raw.touched(since) if raw.buckets == served.buckets else list(range(served.buckets))
    return rows, served.read(buckets=served.meeting(rows, buckets))


def plan_notices(store: Store) -> None:
    """Notices for what served has gained since the last call go to the outbox; what was alerted is remembered.

    The outbox is written first, under keys that a second try makes again, so that no notice is lost or doubled.
    """
    version, done = store.served.version(), store.state.manifest()["notes"].get("served", 0)
    if done >= version:
        return
    rows = store.served.changes(done).where((F.col("sentiment") == "negative") & F.col("id").isNotNull()).cache()
    try:
        marks = _marks(rows)
        known = store.state.read(buckets=store.state.buckets_of(marks))
        alerted = known.where("key like 'id|%'").select(F.substring("key", 4, 1_000_000).alias("id"))
        seen = known.where("key like 'brand|%'").select("brand")
        notices = alerts.plan(rows, alerted, seen)
        key = F.concat_ws("|", F.lit(str(version)), F.col("brand"), F.col("kind"), F.coalesce("id", F.lit("")))
        fresh = notices.select(key.alias("key"), "brand", "kind", "id", "n", F.lit(False).alias("sent"), F.lit(0).alias("attempts"), F.lit(0).alias("seq"))
        store.outbox.upsert(fresh, [])
        store.state.upsert(marks.withColumn("seq", F.lit(0)), [], notes={"served": version})
    finally:
        rows.unpersist()


def _marks(rows: DataFrame) -> DataFrame:
    """Keys of ids and of brands, in one table, so that both are remembered by one commit."""
    brand = F.coalesce("brand", F.lit("?"))
    ids = rows.select(F.concat(F.lit("id|"), "id").alias("key"), brand.alias("brand"))
    return ids.unionAll(rows.select(F.concat(F.lit("brand|"), brand).alias("key"), brand.alias("brand"))).distinct()


def deliver(store: Store, send: Callable[[DataFrame], None], most_attempts: int = MOST_ATTEMPTS) -> bool:
    """Hand unsent notices to `send`; they count as sent if it returns, and are tried again if it fails.

    A notice may come twice if the process dies between sending and noting it, never not at all.
    """
    waiting = store.outbox.read().where((~F.col("sent")) & (F.col("attempts") < most_attempts))
    if waiting.isEmpty():
        return True
    try:
        send(waiting.select("brand", "kind", "id", "n"))
        sent = True
    except Exception:
        log.exception("notices were not sent")
        sent = False
    done = waiting.withColumns({"sent": F.lit(sent), "attempts": F.col("attempts") + 1, "seq": F.lit(0)})
    store.outbox.upsert(done, ["sent", "attempts"])
    return sent


def run(spark: SparkSession, source: DataFrame, root: str, checkpoint: str, send: Callable[[DataFrame], None] | None = None, once: bool = False, provider: Embedder | None = None, buckets: int = 64):
    """Start the stream: every 900 seconds, or over all that is there and then stop."""

    def cycle(batch: DataFrame, batch_id: int) -> None:
        store = Store(spark, root, buckets)
        ingest(store, batch, batch_id, provider)
        if send:
            plan_notices(store)
            deliver(store, send)

    writer = source.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)).start()


def newest_of_batches(rows: DataFrame, per_pass: int) -> DataFrame:
    """Rows (brand, id, captured_at) as (brand, n, newest): for each Arrow batch the count and the newest ids of a brand.

    A brand with very many rows thus sends a few rows to the task that holds its state.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = pc.sort_indices(batch, sort_keys=[("brand", "ascending"), ("captured_at", "descending"), ("id", "ascending")], null_placement="at_start")
            held: dict[str, list] = {}
            for row in batch.take(order).to_pylist():
                mine = held.setdefault(row["brand"], [0, []])
                mine[0] += 1
                if len(mine[1]) < per_pass:
                    mine[1].append({"captured_at": row["captured_at"], "id": row["id"]})
            kind = pa.list_(pa.struct([("captured_at", pa.string()), ("id", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], kind)], ["brand", "n", "newest"])

    return rows.mapInArrow(combine, "brand string, n long, newest array<struct<captured_at string, id string>>")


class BrandState(StatefulProcessor):
    """Notices by brand from its counts and newest ids: the first micro-batch of a brand is its baseline."""

    def __init__(self, per_pass: int = alerts.PER_PASS):
        self.per_pass = per_pass

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "yes boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        total, newest = 0, []
        for frame in rows:
            total += int(frame["n"].sum())
            newest += [(r["captured_at"], r["id"]) for found in frame["newest"] for r in found]
            # latest first, undated ones before all, then by id
            newest = sorted(newest, key=lambda x: x[1])
            newest = sorted(newest, key=lambda x: (x[0] is None, x[0] or ""), reverse=True)[: self.per_pass]
        if not self.known.exists():
            self.known.update((True,))
            out = [(key[0], "baseline", None, total)]
        else:
            out = [(key[0], "alert", i, 1) for _, i in newest]
            if total > self.per_pass:
                out.append((key[0], "overflow", None, total - self.per_pass))
        yield pd.DataFrame(out, columns=["brand", "kind", "id", "n"])

    def close(self) -> None:
        pass


def alert_stream(reviews: DataFrame, per_pass: int = alerts.PER_PASS) -> DataFrame:
    """Notices of a stream of served rows, in two stateful steps: known ids drop out by key of their own, then
    counts and newest ids meet by brand. No task holds the rows of a brand.

    State grows with alerted ids. Of rows that share an id within one micro-batch any one's time counts.
    """
    rows = reviews.where((F.col("sentiment") == "negative") & F.col("id").isNotNull())
    fresh = rows.select(F.coalesce("brand", F.lit("?")).alias("brand"), "id", "captured_at").dropDuplicates(["id"])
    return newest_of_batches(fresh, per_pass).groupBy("brand").transformWithStateInPandas(BrandState(per_pass), "brand string, kind string, id string, n long", "Append", "None")
