"""Toxicity by held-out accuracy, decontamination and archives against brute force."""

import math
import random

import numpy as np

from tests.compare import assert_same, duck
from tests.llm.common_cases import documents, frame, prose
from tidewater.llm import decontamination, queries, toxicity, warc


def labelled(rng, n):
    rows, labels = [], []
    for i in range(n):
        text = prose(rng, rng.randrange(20, 120))
        toxic = rng.random() < 0.25
        if toxic:
            words = text.split(" ")
            for _ in range(rng.randrange(1, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["scum", "Moron,", "vermin"]))
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(1)
    rows, labels = labelled(rng, 500)
    seen = spark.createDataFrame(labels[:300] + [(None, 1), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.train(frame(spark, rows), seen, 300)
    assert model.cuts[0] < model.cuts[1]
    got = {r.doc_id: r for r in toxicity.score(frame(spark, rows), model).collect()}
    right = sum(got[i].toxic == bool(t) for i, t in labels[300:])
    assert right >= 196
    assert all(abs(r.expected_severity - r.p_toxic) <= r.p_toxic + 1e-6 and 0 <= r.grade <= 2 for r in got.values())
    kept = {r.doc_id for r in toxicity.drop_toxic(frame(spark, rows), model).collect()}
    assert kept == {i for i, r in got.items() if not r.toxic}


def test_toxicity_odd_cases(spark):
    none = toxicity.train(frame(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.score(frame(spark), none).collect()
    assert len(got) == len(documents()) and not any(r.toxic for r in got)
    assert toxicity.drop_toxic(frame(spark), none).columns == frame(spark).columns
    assert toxicity.score(frame(spark, []), none).count() == 0


def slow_bm25(items, passage):
    split = [decontamination.words(t.encode()) for _, t in items]
    n, mean = len(split), sum(map(len, split)) / len(split)

    def impact(w, k):
        tf, df = split[k].count(w), sum(w in s for s in split)
        return math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(split[k]) / mean))

    own = [sum(impact(w, k) for w in set(split[k])) for k in range(n)]
    return [sum(impact(w, k) for w in set(passage) if w in split[k]) / own[k] for k in range(n)]


def test_a_label_row_that_repeats_very_often(spark):
    rng = random.Random(9)
    rows, labels = labelled(rng, 300)
    often = spark.createDataFrame(labels, "doc_id long, toxic int").unionAll(spark.range(20_000).selectExpr(f"{labels[0][0]}L AS doc_id", f"{labels[0][1]} AS toxic"))
    once = toxicity.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), 1000)
    model = toxicity.train(frame(spark, rows), often, 1000)
    assert np.allclose(model.weights, once.weights) and np.allclose(model.cuts, once.cuts) and model.weights.any()


def test_bounds_lose_no_item_above_the_threshold():
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randrange(12, 40))) for i in range(50)]
    index = decontamination.build(items)
    order = {i: k for k, (i, _) in enumerate(items)}
    for _ in range(30):
        parts = [prose(rng, 30)] + [items[rng.randrange(50)][1] for _ in range(2)]
        rng.shuffle(parts)
        ws = decontamination.words(" ".join(parts).encode())
        ids = np.array([index.terms.get(w, -1) for w in ws])
        got = {s: dict(f) for s, f in decontamination.search(index, ids, 0.4)}
        step = index.window // 2
        for s in range(0, max(1, len(ws) - step), step):
            scores = slow_bm25(items, ws[s : s + index.window])
            want = {k for k, x in enumerate(scores) if x >= 0.4 + 1e-9}
            found = {order[int(index.ids[k])] for k in got.get(s, {})}
            assert want <= found and all(scores[k] >= 0.4 - 1e-9 for k in found)


def test_long_documents_are_read_in_slices(monkeypatch):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randrange(12, 40))) for i in range(40)]
    index = decontamination.build(items)
    ws = decontamination.words(" ".join(items[rng.randrange(40)][1] if rng.random() < 0.2 else prose(rng, 40) for _ in range(150)).encode())
    ids = np.array([index.terms.get(w, -1) for w in ws])
    found, seen, whole = [], [], decontamination._slice_hits
    monkeypatch.setattr(decontamination, "_slice_hits", lambda i, part, n, step, t: (seen.append(len(part)), whole(i, part, n, step, t))[1])
    for most in (1, 7, 10_000):
        monkeypatch.setattr(decontamination, "SLICE_WINDOWS", most)
        seen.clear()
        found.append(list(decontamination.search(index, ids, 0.4)))
        assert max(seen) <= (most + 1) * index.window // 2
    assert found[0] == found[1] == found[2] and len(found[0]) > 5


def test_postings_of_blocks_below_the_threshold_are_not_read(monkeypatch):
    rng = random.Random(7)
    items = [(i, prose(rng, 30)) for i in range(600)]
    index = decontamination.build(items)
    read, whole = [0], decontamination._postings
    monkeypatch.setattr(decontamination, "_postings", lambda i, e: (lambda p: (read.__setitem__(0, read[0] + len(p)), p)[1])(whole(i, e)))
    ws = decontamination.words((prose(rng, 4000) + " " + items[5][1] + " " + prose(rng, 4000)).encode())
    ids = np.array([index.terms.get(w, -1) for w in ws])
    found = list(decontamination.search(index, ids, 0.4))
    assert any(index.ids[k] == 5 for _, hits in found for k, _ in hits)
    every = sum(int(index.starts[t + 1] - index.starts[t]) for s in range(0, len(ids), index.window // 2) for t in set(ids[s : s + index.window].tolist()) - {-1})
    assert 0 < read[0] < 0.2 * every


def test_hits_are_those_of_a_plain_search(spark):
    """Both ways: every document's verified hits, by plain BM25 over all windows and sets of word triples."""
    rng = random.Random(12)
    items = [(i, prose(rng, rng.randrange(15, 40)).replace("\n", " ")) for i in range(25)]
    docs = []
    for d in range(40):
        parts = [prose(rng, rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            ws = items[rng.randrange(25)][1].split(" ")
            parts += [" ".join(w for w in ws if rng.random() < rng.choice([1.0, 0.95, 0.8])), prose(rng, 30)]
        docs.append((d, " ".join(parts)))
    index, want = decontamination.build(items), set()
    for d, text in docs:
        ws = decontamination.words(text.encode())
        step = index.window // 2
        for s in range(0, max(1, len(ws) - step), step):
            part = ws[s : s + index.window]
            held = decontamination.triples(part)
            for k, score in enumerate(slow_bm25(items, part)):
                q, a = (decontamination.triples(x) for x in decontamination.question_answer(items[k][1]))
                if score >= 0.4 and len(q & held) >= 0.6 * len(q) and len(a & held) >= 0.6 * len(a):
                    want.add((d, k))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 10


def test_decontamination(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, 30).replace("\n", " ")) for i in range(30)] + [(30, None), (None, "x"), (31, ""), (32, "a b c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = documents() + [(500, prose(rng, 100) + " " + items[3][1] + " " + prose(rng, 100)), (501, items[4][1]), (502, " ".join(items[5][1].split()[:12]))]
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame(spark, rows), bench).collect()}
    assert {(500, 3), (501, 4)} <= got and not {d for d, _ in got} - {500, 501}
    assert len(decontamination.indexes(bench, 8)) > 1
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame(spark, rows), bench, most=8).collect()} == got
    # verification against plain sets of word triples, over whole documents: every hit holds its item's question and answer
    held = {d: decontamination.triples(decontamination.words((t or "").encode())) for d, t in rows}
    for d, i in got:
        q, a = (decontamination.triples(x) for x in decontamination.question_answer(dict(items)[i]))
        assert len(q & held[d]) >= decontamination.QUESTION * len(q) and len(a & held[d]) >= decontamination.ANSWER * len(a)
    kept = {r.doc_id for r in decontamination.drop_contaminated(frame(spark, rows), bench).collect()}
    assert kept == {d for d, _ in rows} - {500, 501}
    assert decontamination.contaminated(frame(spark, []), bench).count() == 0
    assert decontamination.contaminated(frame(spark), bench.where("false")).count() == 0


def test_archive_sql(spark, sf_dir):
    assert_same(queries.op7_warc(spark, sf_dir), duck(sf_dir), queries.ORACLE["op7_warc"])


def test_audit_finds_each_fault(spark):
    pages = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 7 + 1)) for i in range(1200)] + [(None, None, None), (None, "u", "v"), (5, "http://h/5", "again")]
    make = lambda rows: warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    same = warc.audit(make(pages), make(pages)).groupBy("status").count().collect()
    assert [tuple(r) for r in same] == [("ok", len(pages))]
    other = [p for p in pages if p[0] != 700] + [(5000, "new", "page")]
    other = [(i, u, h + "!" if i == 100 else h) for i, u, h in other]
    got = warc.audit(make(pages), make(other)).collect()
    status = {(r.page_id, r.status) for r in got}
    assert {(100, "corrupt"), (700, "missing"), (5000, "extra"), (99, "ok"), (701, "moved"), (0, "ok")} <= status
    assert sum(r.status == "corrupt" for r in got) == 1 and len(got) == len(pages) + 1
    none = make([])
    assert warc.audit(none, none).count() == 0
    assert {r.status for r in warc.audit(make(pages[:3]), none).collect()} == {"missing"}
    assert {r.status for r in warc.audit(none, make(pages[:3])).collect()} == {"extra"}


def test_repeated_test_items_count_once(spark):
    items = spark.range(60).selectExpr("1L AS item_id", "'Which river runs through the old town of Karlin? The answer is the slow river Morava of the east' AS text")
    more = spark.createDataFrame([(2, "Who first drew a chart of the northern coast? The answer is captain Elin Strand of Bergen")], "item_id long, text string")
    made = decontamination.indexes(items.unionAll(more), most=10)
    assert sorted(int(i) for index in made for i in index.ids) == [1, 2]
