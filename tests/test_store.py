"""Upserts, snapshots, alerts and the stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions.schema import RAW_SCHEMA, content_key
from tidewater.operators import alerts, enrich, report, store
from tidewater.operators import reviews as R
from tidewater.streaming import pipeline

RAW = "id string, brand string, source string, source_url string, author string, rating double, text string, created_at string, captured_at string, extra string"


def raw(spark, *rows):
    return spark.createDataFrame([(i, "A", "web", "u", who, rating, text, None, at, "{}") for i, who, rating, text, at in rows], RAW)


def test_last_row_wins_and_repeats_change_nothing(spark):
    base = raw(spark, ("1", "x", 1.0, "t", "a"), ("2", "y", 2.0, "t", "a"))
    batch = raw(spark, ("1", "z", 3.0, "new", "b"), ("3", "f", 4.0, "first", "b"), ("3", "g", 5.0, "second", "c")).withColumn("seq", F.monotonically_increasing_id())
    batch = batch.withColumn("seq", F.col("rating"))
    once = store.raw_upsert(base, batch)
    got = {r.id: r for r in once.collect()}
    assert got["1"].rating == 3.0 and got["1"].text == "t" and got["1"].author == "x" and got["1"].captured_at == "b"
    assert got["3"].rating == 5.0 and got["3"].text == "first" and got["2"].rating == 2.0
    assert sorted(map(str, store.raw_upsert(once, batch).collect())) == sorted(map(str, once.collect()))


def test_alert_passes(spark):
    rows = spark.createDataFrame([(f"i{k}", "A" if k < 8 else "B", "negative", f"2024-01-{k + 1:02d}", "t", "web", "u", 1.0) for k in range(10)] + [("p", "A", "positive", "x", "t", "web", "u", 5.0)], "id string, brand string, sentiment string, captured_at string, text string, source string, source_url string, rating double")
    none, seen = spark.createDataFrame([], "id string"), spark.createDataFrame([], "brand string")
    first = alerts.plan(rows, none, seen).collect()
    assert sorted((r.brand, r.kind, r.n) for r in first) == [("A", "baseline", 8), ("B", "baseline", 2)]
    state = alerts.remember(rows.where("brand = 'B'"), none, seen)
    assert alerts.plan(rows.where("brand = 'B'"), *state).count() == 0
    known = spark.createDataFrame([("A",)], "brand string")
    later = alerts.plan(rows.where("brand = 'A'"), none, known).collect()
    assert sum(r.kind == "alert" for r in later) == 5 and [r.n for r in later if r.kind == "overflow"] == [3]
    assert "1.0/5 on web" in alerts.message(rows.where("id = 'i0'")).first().message


def test_providers(spark):
    rows = spark.range(250).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("brand"), F.concat(F.lit("text "), F.col("id")).alias("text")).coalesce(2)
    assert enrich.embed(rows).where(F.size("embedding") == 64).count() == 250

    def judge(brand, texts):
        assert len(texts) <= 25
        return [(i, int(t.split()[1]) % 2 == (brand == "B"), "neutral") for i, t in enumerate(texts)] + [(99, True, "neutral")]

    got = enrich.judge(rows, judge).collect()
    assert len(got) == 250 and all(r.relevant for r in got)


def test_reports(spark, tmp_path):
    path = str(tmp_path / "saved")
    token = report.save(spark, path, "A", json.dumps({"x": 1}), "2024-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        report.save(spark, path, "A", "{}", "2024-01-01T00:00:00Z")
    held = spark.read.parquet(path)
    assert report.saved(held, "a").count() == 1 and report.shared(held, token).first().payload == '{"x": 1}' and report.shared(held, "no").count() == 0
    runs = str(tmp_path / "runs")
    store.append_run(spark, runs, "A", ["web", "yelp"], 3, "ok", "2024-01-01T00:00:00Z", "2024-01-01T00:00:01.5Z")
    assert store.runs(spark.read.parquet(runs)).first().duration_ms == 1500


def test_csv_with_line_breaks(spark, tmp_path):
    rows = spark.createDataFrame([("A", "web", "u", 'say "hi",\nyou', None, "positive", None, "x", "2", "i", True)], "brand string, source string, source_url string, text string, rating double, sentiment string, author string, created_at string, captured_at string, id string, relevant boolean")
    R.write_csv(R.export_rows(rows), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.first().text == 'say "hi",\nyou' and back.count() == 1


def review(k, text):
    return {"id": f"r{k}", "brand": "A", "source": "web", "source_url": f"u{k}", "author": None, "rating": 1.0 if k % 2 else 5.0, "text": text, "created_at": None, "captured_at": f"2024-01-{k:02d}", "extra": "{}"}


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps(review(k, f"t{k}")) for k in (1, 2, 3)))
    sent = []
    source = lambda: spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    go = lambda: pipeline.run(spark, source(), str(tmp_path / "store"), str(tmp_path / "cp"), lambda df: sent.extend(map(tuple, df.collect())), once=True).awaitTermination()
    go()
    assert [(x[1], x[3]) for x in sent] == [("baseline", 2)]
    (folder / "b.json").write_text("\n".join(json.dumps(review(k, f"t{k}")) for k in (3, 5)))
    go()
    assert [(x[1], x[2]) for x in sent[1:]] == [("alert", "r5")]
    served = pipeline.Store(spark, str(tmp_path / "store")).served.read()
    assert sorted((r.id, r.sentiment) for r in served.collect()) == [("r1", "negative"), ("r2", "positive"), ("r3", "negative"), ("r5", "negative")]
    assert served.where("qc_checked").count() == 0 and content_key is not None


def test_state_of_the_alert_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    row = lambda k: json.dumps({"id": f"n{k}", "brand": "A", "sentiment": "negative", "captured_at": f"2024-01-{k:02d}"})

    def go():
        rows = spark.readStream.schema("id string, brand string, sentiment string, captured_at string").json(str(folder))
        q = pipeline.alert_stream(rows).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.kind, r.id or "", r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (folder / "a.json").write_text("\n".join(row(k) for k in (1, 2)))
    assert go() == [("baseline", "", 2)]
    (folder / "b.json").write_text("\n".join(row(k) for k in range(2, 10)))
    assert go() == [("alert", f"n{k}", 1) for k in range(5, 10)] + [("baseline", "", 2), ("overflow", "", 2)]


def test_alert_stream_of_one_brand_equals_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng, schema = random.Random(8), "id string, brand string, sentiment string, captured_at string"
    folder, made = tmp_path / "in", []
    folder.mkdir()
    alerted, seen = spark.createDataFrame([], "id string"), spark.createDataFrame([], "brand string")
    want = []
    for part in range(3):
        rows = [(f"n{rng.randrange(900)}", None if part == 1 and k % 40 == 0 else "A", rng.choice(["negative", "positive"]), rng.choice([None, f"2024-{1 + part:02d}-{1 + k % 28:02d}"])) for k in range(400)]
        known = {r[0]: r for r in made + rows}
        rows = [(i, *known[i][1:]) for i, *_ in rows]  # an id has one brand and time
        made += rows
        frame = spark.createDataFrame(rows, schema)
        want += [tuple(r) for r in alerts.plan(frame, alerted, seen).collect()]
        alerted, seen = (spark.createDataFrame(x.collect(), x.schema) for x in alerts.remember(frame, alerted, seen))
        (folder / f"{part}.json").write_text("\n".join(json.dumps(dict(zip(("id", "brand", "sentiment", "captured_at"), r, strict=True))) for r in rows))
        source = spark.readStream.schema(schema).json(str(folder))
        pipeline.alert_stream(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("brand", "kind", "id", "n").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
