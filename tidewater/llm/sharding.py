"""Shards of equal row counts that keep linked documents together: balanced label propagation.

Links are given as shared keys: documents with the same key are linked (a plain edge is a key of two).
Each round joins the documents to the counts of their key by shard, moves them towards the shard that
holds most of their key while quotas last, and the final step makes counts exact with documents that
have no links.

Cases: a null text has no bytes and counts as an empty one; equal texts are linked, empty ones too; a null doc_id is placed
like any other; repeated rows are placed once each; a key with more documents than a shard takes fills
several; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import persist, ranked

#: Keys with more members than this share of a quota move document by document, others as a whole.
WHOLE = 1 / 64
ROUNDS = 6


def _coin(*cols):
    """An even number in [0, 1) that depends on cols alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _by_shard(values: list[float]):
    return F.element_at(F.array(*map(F.lit, values)), F.col("to") + 1)


def propagate(members: DataFrame, shards: int, quota: float, rounds: int = ROUNDS) -> DataFrame:
    """Adds `shard` to linked documents (node, key, ...): columns node and key must tell rows apart well enough to deal them.

    Start: by hash of node. A round counts each key's documents by shard and joins the counts back; a key
    aims at the shards with room that hold most of it (as many as it fills; any with room, if it lies in
    full ones only), and documents elsewhere ask to move there. Of those that ask, a share goes that the room allows: whole keys by a coin of the
    key, large keys document by document. The driver sees a number for each shard only, and a key has
    at most `shards` counts, aggregated before the shuffle.
    """
    state = members.withColumn("shard", F.pmod(F.xxhash64("node", "n_bytes", F.lit(7)), F.lit(shards)).cast("int"))
    for r in range(rounds):
        counts = state.groupBy("key", "shard").agg(F.count("*").alias("n"))
        counts = persist(counts, "shard-counts")
        load = {x["shard"]: x["n"] for x in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [quota - load.get(s, 0) for s in range(shards)]
        roomy = [float(x > 0) for x in room]
        open_now = F.element_at(F.array(*map(F.lit, roomy)), F.col("shard") + 1) > 0
        order = F.struct("n", F.xxhash64("key", "shard").alias("tie"), "shard")
        spare = [s for s in range(shards) if room[s] > 0]
        any_open = F.array(*map(F.lit, spare)) if spare else F.array().cast("array<int>")
        anew = F.slice(any_open, F.pmod(F.xxhash64("key", F.lit(r)), F.lit(max(1, len(spare)))).cast("int") + 1, 1)
        aims = (
            counts.groupBy("key")
            .agg(F.sum("n").alias("size"), F.count("*").alias("parts"), F.sort_array(F.collect_list(F.when(open_now | (F.col("n") > quota / 2), order)), asc=False).alias("held"))
            .withColumn("aims", F.expr(f"transform(slice(held, 1, cast(ceil(size / {float(quota)}) as int)), x -> x.shard)"))
            .select("key", "size", F.when((F.size("aims") == 0) & (F.col("parts") > 1), anew).otherwise(F.col("aims")).alias("aims"))
        )
        asked = state.join(aims, "key").withColumn(
            "to",
            F.when(
                (F.size("aims") > 0) & ~F.array_contains("aims", F.col("shard")),
                F.element_at("aims", (F.pmod(F.xxhash64("node", "n_bytes", F.lit(r)), F.greatest(F.size("aims"), F.lit(1))) + 1).cast("int")),
            ),
        )
        asked = persist(asked, "shard-moves")
        demand = {x["to"]: x["n"] for x in asked.where("to is not null").groupBy("to").agg(F.count("*").alias("n")).collect()}
        if not demand:
            return asked.select(*state.columns)
        share = [min(1.0, max(0.0, room[s]) / demand[s]) if s in demand else 0.0 for s in range(shards)]
        coin = F.when(F.col("size") <= quota * WHOLE, _coin("key", F.lit(r))).otherwise(_coin("node", "n_bytes", F.lit(~r)))
        state = asked.withColumn("shard", F.when(F.col("to").isNotNull() & (coin < _by_shard(share)), F.col("to")).otherwise(F.col("shard"))).select(*state.columns)
    return persist(state, "shards")


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) under the law `rows`.

    Counts differ by one at most. Linked documents come first in their shard; those beyond a shard's
    count, and documents without links, fill what is left, in the order of a distributed rank.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        F.col("doc_id").alias("node"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.crc32(text).alias("crc"),
        F.xxhash64(text).alias("key"),
    )
    base = persist(base, "shard-base")
    rows = base.count()
    quotas = [rows // shards + (s < rows % shards) for s in range(shards)]
    linked_keys = base.where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    marked = persist(base.join(linked_keys.withColumn("linked", F.lit(True)), "key", "left").select(*base.columns, F.coalesce("linked", F.lit(False)).alias("linked")), "shard-linked")
    linked = marked.where("linked").drop("linked")
    free = marked.where("not linked").drop("linked")
    placed = propagate(linked, shards, rows / shards, rounds)
    placed = persist(ranked(placed, ["shard"], ["key", "node", "n_bytes", "crc"], "slot", linked.count()), "shard-placed")
    limit = F.element_at(F.array(*map(F.lit, quotas)), F.col("shard") + 1)
    stay = placed.where(F.col("slot") < limit)
    loose = placed.where(F.col("slot") >= limit).select(*base.columns).unionAll(free)
    taken = {x["shard"]: x["n"] for x in stay.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    loose = ranked(loose.withColumn("_all", F.lit(0)), ["_all"], ["node", "n_bytes", "crc"], "place", rows).drop("_all")
    upto, ends = 0, []
    for s in range(shards):
        upto += quotas[s] - taken.get(s, 0)
        ends.append(upto)
    shard = F.aggregate(F.array(*map(F.lit, ends)), F.lit(0), lambda n, end: n + F.when(F.col("place") >= end, 1).otherwise(0))
    firsts = F.array(*[F.lit(taken.get(s, 0) - (ends[s - 1] if s else 0)).cast("long") for s in range(shards)])
    filled = loose.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("place") + F.element_at(firsts, F.col("shard") + 1))
    columns = [
        F.col("node").alias("doc_id"),
        (F.col("n_bytes") + 8).alias("size"),
        F.col("crc").cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    ]
    return stay.select(*columns).unionAll(filled.select(*columns))
