"""Bucketed tables, their streams of batches, and what a failure at any step leaves behind."""

import json
import random
import shutil

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tidewater.functions.schema import RAW_SCHEMA
from tidewater.operators import store
from tidewater.operators.tables import BucketedTable, Conflict, Folder
from tidewater.streaming import pipeline

SCHEMA = "id string, text string, rating double, tags array<float>"


def rows(spark, *made):
    return spark.createDataFrame([(i, t, r, None, q) for i, t, r, q in made], "id string, text string, rating double, tags array<float>, seq int")


def held(table):
    return sorted((r.id, r.text, r.rating) for r in table.read().collect())


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, 8)
    assert held(table) == [] and table.version() == 0
    first = table.upsert(rows(spark, *[(str(k), "t", float(k), 0) for k in range(60)]), ["rating"])
    before = table.manifest()["folders"]
    assert len(before) == 8
    second = table.upsert(rows(spark, ("5", "other", 50.0, 1), ("5", "other", 51.0, 2), ("new", "a", 1.0, 1), ("new", "b", 2.0, 2)), ["rating"])
    after = table.manifest()["folders"]
    changed = {b for b in after if after[b] != before.get(b)}
    assert second == first + 1 and 1 <= len(changed) <= 2 and {int(b) for b in changed} == set(table.touched(first))
    want = [(str(k), "t", float(k)) for k in range(60) if k != 5] + [("5", "t", 51.0), ("new", "a", 2.0)]
    assert held(table) == sorted(want)
    assert sorted((r.id, r.rating) for r in table.changes(first).collect()) == [("5", 51.0), ("new", 2.0)]
    assert table.changes(0).count() == 61 and table.changes(second).count() == 0
    assert table.read(first).count() == 60
    reopened = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, 999)
    assert reopened.buckets == 8 and held(reopened) == sorted(want)


def test_the_first_load_writes_rows_once(spark, tmp_path, monkeypatch):
    """One shuffle by bucket and one write; keys that repeat, keyless rows and empty batches as ever."""
    table, written = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, 4), []
    parquet = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (written.append(path), parquet(self, path, *a, **k))[1])
    with pytest.raises(ValueError):
        table.upsert(rows(spark, ("a", "x", 1.0, 0), (None, "x", 1.0, 0)), ["rating"])
    assert table.upsert(rows(spark, ("a", "x", 1.0, 0)).limit(0), ["rating"]) == 0
    assert Folder(spark, str(tmp_path / "t")).names("data") == []
    written.clear()
    table.upsert(rows(spark, ("a", "y", 2.0, 2), ("a", "x", 1.0, 1), ("b", "z", None, 0)), ["rating"])
    assert len(written) == 1 and held(table) == [("a", "x", 2.0), ("b", "z", None)]


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path):
    """A task need not read a whole bucket, neither at the first load nor later; each key lies in one place."""
    table, data = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, 2), Folder(spark, str(tmp_path / "t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for seq in (0, 1):
            table.upsert(rows(spark, *[(str(k), "t", float(k + seq), seq) for k in range(400)]), ["rating"])
            files = [[n for n in data.names(f) if n.endswith(".parquet")] for f in table.manifest()["folders"].values()]
            assert len(files) == 2 and all(len(x) > 1 for x in files)
            assert held(table) == sorted((str(k), "t", float(k + seq)) for k in range(400))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_new_keys_are_added_and_known_ones_rewrite_their_bucket(spark, tmp_path, monkeypatch):
    """A batch of new keys writes its own rows only; the buckets' earlier folders stay, up to a number of them."""
    table, written = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, 2), []
    parquet = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (written.append(path), parquet(self, path, *a, **k))[1])
    table.upsert(rows(spark, *[(str(k), "t", float(k), 0) for k in range(20)]), ["rating"])
    before = table.manifest()["folders"]
    table.upsert(rows(spark, *[(str(k), "t", float(k), 0) for k in range(20, 40)]), ["rating"])
    after = table.manifest()["folders"]
    assert len(written) == 2 and all(after[b][0] == before[b] and len(after[b]) == 2 for b in before)
    assert table.written(1).count() == 20 == table.changes(1).count() and table.read(1).count() == 20
    # a known key beside a new one: its bucket becomes one folder again, the other stays as it is
    table.upsert(rows(spark, ("3", "u", 33.0, 0)), ["rating"])
    last = table.manifest()["folders"]
    assert sorted(type(f).__name__ for f in last.values()) == ["list", "str"]
    assert held(table) == sorted((str(k), "t", 33.0 if k == 3 else float(k)) for k in range(40))
    assert [(r.id, r.rating) for r in table.changes(2).collect()] == [("3", 33.0)] and table.changes(1).count() == 21
    for k in range(40, 52):
        table.upsert(rows(spark, *[(f"{k}-{i}", "t", 0.0, 0) for i in range(8)]), ["rating"], once=k % 2 == 0)
    assert all(len(f) <= 8 for f in table.manifest()["folders"].values() if isinstance(f, list)) and table.read().count() == 40 + 12 * 8
    assert table.vacuum(1) > 0 and table.read().count() == 40 + 12 * 8


def test_upserts_equal_the_plan(spark, tmp_path):
    rng = random.Random(3)
    table, whole = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, 4), spark.createDataFrame([], SCHEMA)
    for _ in range(3):
        batch = rows(spark, *[(str(rng.randrange(30)), f"t{rng.randrange(9)}", rng.random(), k) for k in range(40)])
        table.upsert(batch, ["rating"])
        merged = store.upsert(whole, batch, ["rating"])
        whole = spark.createDataFrame(merged.collect(), SCHEMA)
    assert held(table) == sorted((r.id, r.text, r.rating) for r in whole.collect())


def test_batches_count_once_and_empty_ones_are_remembered(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, 4)
    one = rows(spark, ("a", "x", 1.0, 0))
    assert table.upsert(one, ["rating"], stream="s", batch_id=0) == 1
    assert table.upsert(rows(spark, ("a", "x", 9.0, 0)), ["rating"], stream="s", batch_id=0) == 1
    assert table.upsert(one.limit(0), ["rating"], stream="s", batch_id=1) == 2
    assert table.upsert(one.limit(0), ["rating"]) == 2
    assert table.upsert(rows(spark, ("a", "x", 3.0, 0)), ["rating"], stream="other", batch_id=0) == 3
    assert held(table) == [("a", "x", 3.0)]
    with pytest.raises(ValueError):
        table.upsert(rows(spark, (None, "x", 1.0, 0)), ["rating"])
    assert table.version() == 3 and len(Folder(spark, str(tmp_path / "t")).names("data")) == 2


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    table, other = (BucketedTable(spark, str(tmp_path / "t"), SCHEMA, 2) for _ in range(2))
    table.upsert(rows(spark, ("a", "x", 1.0, 0)), ["rating"])
    commit, came = BucketedTable._commit, []

    def meanwhile(self, *args):
        if self is table and not came:
            came.append(1)
            other.upsert(rows(spark, ("b", "y", 2.0, 0), ("a", "z", 5.0, 0)), ["rating"])
        return commit(self, *args)

    monkeypatch.setattr(BucketedTable, "_commit", meanwhile)
    table.upsert(rows(spark, ("c", "w", 3.0, 0)), ["rating"])
    assert held(table) == [("a", "x", 5.0), ("b", "y", 2.0), ("c", "w", 3.0)] and table.version() == 3
    monkeypatch.setattr(BucketedTable, "_commit", lambda *a: None)
    with pytest.raises(Conflict):
        table.upsert(rows(spark, ("d", "w", 3.0, 0)), ["rating"])


def test_vacuum_keeps_what_versions_name(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, 4)
    for k in range(4):
        table.upsert(rows(spark, *[(str(i), "x", float(k), 0) for i in range(12 if k == 0 else 2)]), ["rating"])
    want = held(table)
    assert table.vacuum(1) > 0 and table.versions() == [4] and held(table) == want
    assert table.vacuum(1) == 0
    with pytest.raises(ValueError):
        table.changes(1)
    assert table.touched(1) == table.touched(0)


def test_files_are_whole_or_absent(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "f"))
    assert folder.put("a.txt", "one") and not folder.put("a.txt", "two") and folder.text("a.txt") == "one"
    assert folder.put("a.txt", "three", replace=True) and folder.text("a.txt") == "three"
    assert folder.names() == ["a.txt"] and folder.names("none") == []


# ---- a stream's batch that dies at any step


def review(k, rating, text):
    return {"id": f"r{k}", "brand": f"B{k % 3}", "source": "web", "source_url": f"u{k}", "author": None, "rating": rating, "text": text, "created_at": None, "captured_at": f"2024-01-{1 + k % 28:02d}", "extra": "{}"}


def batches(spark):
    parts = [[review(k, 1.0 + k % 5, f"text {k}") for k in range(20)], [review(k, 2.0, f"text {k}") for k in range(15, 40)], [review(k, 1.0, f"text {k}") for k in range(38, 44)]]
    return [spark.createDataFrame([tuple(r.values()) for r in part], RAW_SCHEMA) for part in parts]


def cycle(spark, root, batch, number, sent):
    kept = pipeline.Store(spark, root, 2)
    pipeline.ingest(kept, batch, number)
    pipeline.plan_notices(kept)
    pipeline.deliver(kept, lambda df: sent.extend(map(tuple, df.collect())))
    return [sorted(map(str, t.read().drop("key", "attempts").collect())) for t in (kept.raw, kept.served, kept.state, kept.outbox)]


def test_a_batch_that_dies_at_any_step_takes_effect_once(spark, tmp_path, monkeypatch):
    """The second batch dies at each commit, before or after it takes effect, and is then replayed."""
    one, two, three = batches(spark)
    cycle(spark, str(tmp_path / "first"), one, 0, [])
    commit, steps, dies_at = BucketedTable._commit, [0], [0]

    def may_die(self, *args):
        steps[0] += 1
        if steps[0] == dies_at[0]:
            raise OSError("before")
        done = commit(self, *args)
        if steps[0] == -dies_at[0]:
            raise OSError("after")
        return done

    monkeypatch.setattr(BucketedTable, "_commit", may_die)

    def play(n):
        root, sent = str(tmp_path / f"dies{n}"), []
        shutil.copytree(tmp_path / "first", root)
        steps[0], dies_at[0] = 0, n
        try:
            return cycle(spark, root, two, 1, sent), sent
        except OSError:
            dies_at[0] = 0
            return cycle(spark, root, two, 1, sent), sent

    want, sent = play(0)
    assert len(want[0]) == 40 == len(want[1]) and {x[1] for x in sent} == {"alert", "overflow"}
    last = steps[0]
    for n in (1, last, *range(-last, 0)):
        tables, again = play(n)
        assert tables == want, n
        # only the note that notices were sent, if it is lost, brings them again
        assert sorted(set(again), key=repr) == sorted(sent, key=repr) and len(again) == len(sent) * (2 if n == last else 1)


def test_notices_are_tried_again_and_given_up(spark, tmp_path):
    kept = pipeline.Store(spark, str(tmp_path / "s"), 4)
    pipeline.ingest(kept, batches(spark)[0], 0)
    pipeline.plan_notices(kept)

    def fails(_):
        raise OSError("no network")

    assert not pipeline.deliver(kept, fails, 2) and not pipeline.deliver(kept, fails, 2)
    assert kept.outbox.read().where("attempts = 2 and not sent").count() == kept.outbox.read().count() > 0
    assert pipeline.deliver(kept, fails, 2)  # nothing is left to try
    got = []
    assert pipeline.deliver(kept, lambda df: got.extend(df.collect()), 3) and len(got) == kept.outbox.read().where("sent").count()


def test_pending_by_changed_buckets_equals_the_join(spark, tmp_path):
    one, two, _ = batches(spark)
    kept = pipeline.Store(spark, str(tmp_path / "s"), 4)
    pipeline.ingest(kept, one, 0)
    done = kept.served.manifest()["notes"]["raw"]
    kept.raw.upsert(pipeline.sequenced(two), store.RAW_UPDATES)
    by_feed = store.pending_enrichment(*pipeline.pending_sides(kept.raw, kept.served, done))
    whole = store.pending_enrichment(kept.raw.read(), kept.served.read())
    assert sorted(r.id for r in by_feed.collect()) == sorted(r.id for r in whole.collect()) != []
    assert json.dumps(kept.raw.manifest()) and kept.raw.touched(done) and F is not None


def test_brands_of_two_writers_are_both_kept(spark, tmp_path, monkeypatch):
    from tidewater.sources.brands import BrandFile

    one, two = (BrandFile(spark, str(tmp_path / "brands")) for _ in range(2))
    assert one.read() == [] and one.add({"name": " Blue  Bottle ", "keywords": ["é"]})
    newest, came = BrandFile._newest, []

    def meanwhile(self):
        found = newest(self)
        if self is one and not came:
            came.append(two.add({"name": "Acme"}))
        return found

    monkeypatch.setattr(BrandFile, "_newest", meanwhile)
    assert one.add({"name": "Peet"}) and came == [True]
    assert [b["name"] for b in two.read([{"name": "ACME", "limit": 3}])] == ["ACME", "Blue Bottle", "Peet"]
    assert not two.add({"name": "blue bottle"}) and two.read()[0]["keywords"] == ["é"]
    with pytest.raises(ValueError):
        one.add({"name": "  "})
    (tmp_path / "brands" / "brands-000009.yml").write_text("{broken")
    assert one.add({"name": "New"}) and [b["name"] for b in one.read()] == ["New"]
