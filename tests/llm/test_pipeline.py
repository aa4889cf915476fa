"""The stages one after another, each on what its predecessor kept."""

import collections

import corpus_pipeline
from tests.llm.common_cases import documents, frame
from tidewater.llm import common, packing
from tidewater.llm.common import table


def test_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and kept <= before and len(kept) > 0.7 * len(before), name
        before = kept
    assert docs.where("n_chars <> length(text)").count() == 0
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    encode = packing.Encoder(packing.vocabulary())
    total = collections.Counter()
    for r in rows:
        total[r.doc_id] += r.length
    assert total == {r.doc_id: len(encode(r.text or "")) // 4 + 1 for r in docs.collect()}
    again = corpus_pipeline.run(spark, sf_dir).groupBy("doc_id").sum("length").collect()
    assert dict(map(tuple, again)) == dict(total)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]


def odd_tables(spark, folder, docs):
    """Documents with nulls, empty and long texts, copies, repeated rows; labels and items that repeat or are null."""
    frame(spark, docs).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 4 == 0), 1) for i in range(40)] * 3 + [(None, 1, 1), (7, None, 1), (60, 0, 0), (5000, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    items = [(0, "alpha1 bravo2 charlie3 delta4 echo5 foxtrot6. golf7 hotel8 india9 juliet1"), (0, "alpha1 bravo2 charlie3 delta4 echo5 foxtrot6. golf7 hotel8 india9 juliet1"), (1, None), (None, "x y z"), (2, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_on_odd_documents(spark, tmp_path):
    docs = documents() + [(90, "kilo2 lima3 " + "alpha1 bravo2 charlie3 delta4 echo5 foxtrot6. golf7 hotel8 india9 juliet1" + " mike4 november5")]
    sf_dir = odd_tables(spark, tmp_path, docs)
    held = table(spark, sf_dir, "documents")
    columns = held.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, held, sf_dir).write.parquet(str(tmp_path / f"after{k}"))
        after = spark.read.parquet(str(tmp_path / f"after{k}"))
        assert after.columns == columns, name
        ids = collections.Counter(r.doc_id for r in after.select("doc_id").collect())
        assert not ids - collections.Counter(r.doc_id for r in held.select("doc_id").collect()), name
        # rows without text: near-duplicate removal keeps one of them, every other stage all
        blank = [r for r in after.collect() if not (r.text or "").strip()]
        assert len(blank) == (1 if k >= 2 else 4), name
        held = after
    kept = {r.doc_id: r.text for r in held.collect()}
    assert 90 not in kept and 67 in kept
    assert not kept.keys() & set(range(40, 46))  # of equal documents the first stays
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in pieces.collect()} == set(kept)


def test_stages_on_no_documents(spark, tmp_path):
    sf_dir = odd_tables(spark, tmp_path, [])
    before = len(common.SCRATCH)
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
    assert len(common.SCRATCH) <= before + 1  # a stage's own tables go when it is written
