"""SimHash, lines, passages and repeated strings against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm.common_cases import documents, edited, frame, prose
from tidewater.llm import buckets, common, linededup, runindex, simhash, substring


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups_are_exact(spark):
    rows = [(i, t) for i, t in documents() if i is not None]
    got = simhash.group_documents(frame(spark, rows)).collect()
    prints = {(i, t): slow_fingerprint(t) for i, t in rows}
    values = sorted(set(prints.values()))
    pairs = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2]
    root = groups(pairs, values)
    least = {}
    for (i, _), f in prints.items():
        least[root[f]] = min(i, least.get(root[f], i))
    want = collections.Counter((i, f"{prints[i, t]:016x}", least[root[prints[i, t]]]) for i, t in rows)
    assert want == collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got)
    assert simhash.group_documents(frame(spark)).where("component_id is null and doc_id is not null").count() == 0
    assert simhash.group_documents(frame(spark, [])).count() == 0


@pytest.mark.parametrize("bucket", [2, 8, 256])
def test_links_lose_nothing_in_large_buckets(spark, bucket):
    rng = random.Random(3)
    values = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(14):
            values.add(x)
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    edges = simhash.link_fingerprints(spark.createDataFrame([(v,) for v in values], "fp long"), 2, bucket=bucket).collect()
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    assert all(near(e.a, e.b) for e in edges)
    want = groups([(a, b) for a in values for b in values if a < b and near(a, b)], values)
    assert groups([(e.a, e.b) for e in edges], values) == want


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)]
    nodes = sorted({x for p in pairs if p[0] != p[1] for x in p})
    got = {r.node: r.root for r in common.components(spark.createDataFrame(pairs, "a long, b long"), "t").collect()}
    assert got == groups(pairs, nodes)
    assert common.components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_ranks_are_gapless(spark):
    df = spark.range(500).selectExpr("id % 3 as k", "id % 50 as v")
    got = common.ranked(df, ["k"], ["v"], "place", 500, per_bucket=20).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.k].append(r.place)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(got) == 500


def jaccard(a, b):
    cut = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("bucket", [4, 256])
def test_near_duplicates(spark, bucket):
    rng = random.Random(11)
    rows = [(i, prose(rng, 300)) for i in range(60)]
    rows += [(100 + i, edited(rng, rows[i][1], 0.008)) for i in range(30)]
    rows += [(200 + i, edited(rng, rows[0][1], 0.005)) for i in range(30)]
    rows += [(300, rows[5][1]), (400, None), (401, "")]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(spark, rows), bucket).collect()}
    text = dict(rows)
    sure = [(i, j) for i in range(60) for j in [*range(100, 130), *range(200, 230), 300] if jaccard(text[i], text[j]) >= 0.87]
    assert len(sure) > 40 and all(got[a] == got[b] for a, b in sure)
    for i in range(60):
        assert got[i] == i
    assert got[401] == 400
    kept = {r.doc_id for r in simhash.keep_one(frame(spark, rows)).collect()}
    assert kept == {d for d, c in got.items() if d == c}
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_cut_and_appended_copies_at_the_threshold(spark):
    """Contiguous edits: 196 of 245 shingles are shared, which is 0.8."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**9)}"
    rows = []
    for i in range(40):
        words = [word() for _ in range(249)]
        rows += [(i, " ".join(words)), (100 + i, " ".join(words[:200] if i % 2 else words[49:]))]
        rows.append((200 + i, " ".join(words[60:] + [word() for _ in range(60)])))  # below 0.8
    text = dict(rows)
    assert all(round(jaccard(text[i], text[100 + i]), 9) == 0.8 for i in range(40))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert sum(got[100 + i] == i for i in range(40)) >= 39
    far = [i for i in range(40) if jaccard(text[i], text[200 + i]) < 0.8 and jaccard(text[100 + i], text[200 + i]) < 0.8]
    assert far and all(got[200 + i] == 200 + i for i in far)


def test_near_copies_go_by_row(spark):
    rng = random.Random(13)
    one, two, three = (prose(rng, 200) for _ in range(3))
    rows = [(1, one), (2, one + " more"), (2, two), (None, three), (None, three + " more"), (None, one + " again")]
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(frame(spark, rows)).collect())
    assert kept[1:] == [(1, one), (2, two)]
    assert kept[0] in [(0, three), (0, three + " more")]


def slow_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j] + 1, row[j + 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(14))) for _ in range(2))
        d = slow_levenshtein(a, b)
        assert linededup.edit_distance(a, b, 20) == d
        assert linededup.edit_distance(a, b, 3) == (d if d <= 3 else 4)


def test_line_dedup(spark):
    rng = random.Random(9)
    lines = [prose(rng, 20).replace("\n", " ") for _ in range(12)]
    near = lines[0] + "y"
    rows = [(1, lines[0] + "\n" + lines[1]), (2, near + "\n" + lines[2] + "\nshort one"), (3, lines[1].upper() + "!\n" + lines[3] + "\nshort one"), (4, lines[3] + "\n\n" + lines[3]), (5, None), (6, ""), (None, lines[4] + "\n" + lines[1]), (7, lines[5]), (7, lines[5])]
    got = linededup.dedup_lines(frame(spark, rows)).collect()
    text = collections.defaultdict(list)
    for r in got:
        text[r.doc_id].append((r.text, r.n_removed))
    assert text[1] == [(rows[0][1], 0)]
    assert text[2] == [(lines[2] + "\nshort one", 1)]
    assert text[3] == [(lines[3], 2)]
    assert text[4] == [("", 2)]
    assert text[5] == [(None, 0)] and text[6] == [("", 0)]
    assert text[None] == [(lines[4], 1)]
    assert text[7] == [(lines[5], 0)] * 2
    assert set(frame(spark).columns) <= set(linededup.dedup_lines(frame(spark)).columns)
    assert linededup.dedup_lines(frame(spark, [])).count() == 0


def test_short_lines_go_by_their_words(spark):
    """Lines of one to four words, and lines in scripts without spaces, go if they repeat; other numbers make other lines."""
    long = "這是一行很長的沒有空格的文字需要整行相同才會被刪除"
    rows = [(1, "Thanks.\nPage 12\n" + long + "\n---"), (2, "thanks!\nPage 13\n" + long + "\n---\n2024"), (3, "Page 12\n2025\nThanks a lot\n" + long + "了"), (None, "2024\n" + "x " * 9 + "\nThanks")]
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    assert got[1] == (rows[0][1], 0)
    assert got[2] == ("Page 13\n---\n2024", 2)
    assert got[3] == ("2025\nThanks a lot\n" + long + "了", 1)
    assert got[None] == ("x " * 9, 2)


def test_lines_in_large_buckets(spark):
    """Chunks of a bucket meet each other, so a small bucket size finds the same links."""
    rng = random.Random(4)
    base = prose(rng, 60).replace("\n", " ")
    rows = [(i, edited(rng, base, 0.01)) for i in range(40)]
    small = linededup.line_prints(frame(spark, rows).withColumn("row", common.F.col("doc_id")), 4)
    distinct = small.select("line", "print").dropDuplicates(["line"]).cache()
    for bucket in (3, 256):
        sets = [set(r.lines) for r in linededup.candidates(distinct, 40, bucket).collect()]
        nodes = [r.line for r in distinct.collect()]
        root = groups([(a, b) for s in sets for a in s for b in s], nodes)
        assert max(collections.Counter(root.values()).values()) > 0.9 * len(nodes)


def test_near_rows_of_a_large_bucket_all_meet(spark):
    """One key for all rows, near ones far apart in its order: those not connected yet meet all the same."""
    rng = random.Random(6)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    values = [rng.getrandbits(64) for _ in range(300)]
    values += [v ^ (1 << 63) ^ (1 << rng.randrange(60)) for v in values[:150]]
    prints = spark.createDataFrame([(i, [signed(v), 7]) for i, v in enumerate(values)], "id long, print array<long>")
    sets, chunks = buckets.band_sets(prints, 450, 3, 16)
    together = lambda df: {(a, b) for r in df.collect() for a in r.members for b in r.members if a < b}
    near = {(i, j) for i in range(450) for j in range(i + 1, 450) if (values[i] ^ values[j]).bit_count() <= 3}
    assert len(near) >= 150 and near - together(sets)
    none = spark.createDataFrame([], "node long, root long")
    assert near <= together(sets) | together(buckets.rest_sets(chunks, none, 3))
    some = sorted(near)[:75]
    groups_ = spark.createDataFrame([(i, a) for a, b in some for i in (a, b)], "node long, root long")
    left = together(buckets.rest_sets(chunks, groups_, 3))
    assert near - set(some) <= left
    one = spark.createDataFrame([(i, 0) for i in range(450)], "node long, root long")
    assert buckets.rest_sets(chunks, one, 3).count() == 0


def test_rows_of_a_large_bucket_leave_by_pairs_that_fit(spark):
    """Every pair that size, bins and fingerprint let be alike meets; strangers of like fingerprints don't leave at all."""
    rng, np_rng = random.Random(7), np.random.default_rng(7)
    n = 600  # the last 150 are like the first ones, a tenth longer; every bin of row 449 is full
    values = [rng.getrandbits(12) for _ in range(450)]
    values += [v ^ 1 for v in values[:150]]
    bins = np.zeros((n, 256), np.int64)
    for k in range(450):
        bins[k, np_rng.choice(256, 20, replace=False)] = np_rng.integers(2, 12, 20) * (1 + k % 9)
    bins[449] = 300
    bins[450:] = bins[:150]
    bins[450:, 0] += bins[450:].sum(1) // 10
    size, most = bins.sum(1), 8
    chunks = spark.createDataFrame([(7, k // 16, list(range(k, min(k + 16, n))), values[k : k + 16]) for k in range(0, n, 16)], "key long, chunk int, ids array<long>, p array<long>")
    stored = spark.createDataFrame([(k, int(size[k]), bytearray(np.minimum(bins[k], 255).astype(np.uint8).tobytes())) for k in range(n)], "id long, size int, bins binary")
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if (values[i] ^ values[j]).bit_count() <= most and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]) and np.minimum(bins[i], bins[j]).sum() >= 0.5 * max(size[i], size[j])}
    none = spark.createDataFrame([], "node long, root long")
    found = buckets.rest_fits(chunks, none, stored, most, 0.8, 0.5).collect()
    together = {(a, b) for r in found for a in r.members for b in r.members if a < b}
    assert {(k, 450 + k) for k in range(150)} <= want <= together
    assert sum(len(r.members) for r in found) < 3 * len(want)
    assert sum(len(r.members) for r in buckets.rest_sets(chunks, none, most).collect()) > 5 * sum(len(r.members) for r in found)
    assert all(v == values[i] and root == i for r in found for i, v, root in zip(r.members, r.p, r.root, strict=True))
    one = spark.createDataFrame([(i, 0) for i in range(n)], "node long, root long")
    assert buckets.rest_fits(chunks, one, stored, most, 0.8, 0.5).count() == 0


def test_lines_and_documents_of_large_buckets(spark):
    """The size of chunks makes no difference."""
    rng = random.Random(8)
    head = "extraordinarily comprehensive administrative documentation"
    base = [f"{head} {prose(rng, 14)}".replace("\n", " ") for _ in range(40)]
    rows = [(i, x) for i, x in enumerate(base)] + [(100 + 10 * i + k, edited(rng, x, 0.04)) for i, x in enumerate(base) for k in range(3)]
    got = [sorted((r.doc_id, r.n_removed) for r in linededup.dedup_lines(frame(spark, rows), bucket).collect()) for bucket in (2, 10_000)]
    assert got[0] == got[1] and sum(n for _, n in got[0]) > 60


@pytest.mark.parametrize("words, changed", [(8, 1), (12, 2), (27, 4)])
def test_lines_at_the_threshold(spark, words, changed):
    """Whole words changed, up to edit similarity 0.8: nearly all pairs meet, whatever the number of rows planned for."""
    rng = random.Random(words)
    word = lambda: f"{rng.randrange(10**6):06d}".translate(str.maketrans("0123456789", "abcdefghij"))
    rows = []
    for i in range(100):
        line = [word() for _ in range(words)]
        other = list(line)
        for k in rng.sample(range(words), changed):
            other[k] = word()
        rows += [(i, " ".join(line)), (1000 + i, " ".join(other))]
    text = dict(rows)
    true = [i for i in range(100) if linededup.alike(text[i], text[1000 + i])]
    got = {r.doc_id: r.n_removed for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    assert len(true) > 90 and sum(got[1000 + i] for i in true) >= 0.97 * len(true)
    assert not any(got[i] for i in range(100))


def test_compact_windows_hold_all_minima():
    rng = np.random.default_rng(1)
    for _ in range(30):
        h = rng.integers(1, 2**63, 70, dtype=np.uint64)
        h[rng.integers(0, 70, 2)] = 0
        got = dict(zip(*[x.tolist() for x in (lambda p, a, b: (p, np.stack([a, b], 1)))(*substring.compact_windows(h, 8))], strict=True))
        want = {}
        for i in range(70):
            for j in range(i + 7, 70):
                part = h[i : j + 1]
                if (part == 0).any():
                    continue
                x = i + int(part.argmin())
                a, b = want.get(x, (i, j))
                want[x] = (min(a, i), max(b, j))
        assert {k: tuple(v) for k, v in got.items()} == want


def test_passages(spark):
    rng = random.Random(21)
    shared = prose(rng, 90).replace("\n", " ")
    near = edited(rng, shared, 0.01)
    rows = [(i, prose(rng, 200)) for i in range(20)]
    rows += [(30 + i, prose(rng, 60) + " " + (shared if i % 2 else near) + " " + prose(rng, 60)) for i in range(6)]
    rows += [(50, rows[3][1]), (51, "short text"), (52, "short text"), (60, None), (61, ""), (None, rows[4][1])]
    got = {r.doc_id: r for r in substring.group_passages(frame(spark, rows)).collect()}
    assert len({got[30 + i].class_id for i in range(6)}) == 1 and got[30].class_id == 30
    assert all(got[30 + i].n_links > 0 and got[30 + i].spans for i in range(6))
    span = got[31].spans[0]
    words = dict(rows)[31].split()
    assert abs(span.start - 60) <= 5 and abs(span.stop - 150) <= 5, (span, len(words))
    assert got[50].class_id == 3 and got[50].n_copies == 1
    assert all(got[i].class_id == i and got[i].n_links == 0 for i in range(20) if i not in (3, 4))
    assert got[51].class_id == 51 and got[52].class_id == 52 and got[60].class_id == 60
    assert got[None].class_id == 4
    assert substring.group_passages(frame(spark, [])).count() == 0


@pytest.mark.parametrize("bucket", [7, 256])
def test_all_texts_of_a_passage_meet(spark, bucket):
    """One word changed in each copy: every two copies that are alike count, whatever lies between them."""
    rng = random.Random(31)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = [(99, " ".join(base))] + [(i, " ".join(base[:i] + [f"new{i}"] + base[i + 1 :])) for i in range(60)]
    known = substring.word_hashes()
    cut = {i: substring.shingles(t.encode(), known) for i, t in rows}
    links = {(i, j) for i in cut for j in cut if i != j and substring.alike_part(cut[i], cut[j])}
    got = {r.doc_id: r for r in substring.group_passages(frame(spark, rows), bucket).collect()}
    # the rest is lost to the agreement of two of four min-hashes
    assert sum(r.n_links for r in got.values()) >= 0.9 * len(links) > 1000


@pytest.mark.parametrize("bucket", [70, 256])
def test_large_groups_of_a_passage_are_one_class(spark, bucket):
    """More texts than meet each other directly, with and without chunks: nobody is lost."""
    rng = random.Random(32)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for k in rng.sample(range(120), 2):
            words[k] = f"new{i}x{k}"
        rows.append((i, " ".join(f"own{i}x{k}" for k in range(30)) + " " + " ".join(words)))
    rows += [(1000 + i, " ".join(f"else{i}x{k}" for k in range(90))) for i in range(20)]
    got = {r.doc_id: r for r in substring.group_passages(frame(spark, rows), bucket).collect()}
    assert sum(got[i].class_id == 0 for i in range(300)) >= 297
    assert sum(got[i].n_links > 0 for i in range(300)) >= 297
    assert all(got[1000 + i].class_id == 1000 + i and not got[1000 + i].spans for i in range(20))


@pytest.mark.parametrize("bucket", [70, 256])
def test_links_of_a_large_min_hash_are_all_found(spark, bucket):
    """Most of a passage stands in all texts, the rest in two of them: those two are found, wherever they lie among all."""
    rng = random.Random(34)
    word = lambda: f"w{rng.randrange(10**9)}"
    common_words = [word() for _ in range(40)]
    rows = []
    for i in range(150):
        half = common_words + [word() for _ in range(15)]
        rows += [(k + i, " ".join([word() for _ in range(20)] + half + [word() for _ in range(20)])) for k in (0, 1000)]
    got = {r.doc_id: r for r in substring.group_passages(frame(spark, rows), bucket).collect()}
    assert [i for i in range(150) if got[1000 + i].class_id != i or got[i].class_id != i] == []
    assert all(r.n_links == 1 and len(r.spans) == 1 for r in got.values())


def test_groups_with_a_short_piece_in_common_leave_no_pairs(spark, monkeypatch):
    """Thirty words stand in all texts, the rest in three copies each: copies are one class, and no pair of classes goes on."""
    rng = random.Random(36)
    word = lambda: f"w{rng.randrange(10**9)}"
    piece, rows = [word() for _ in range(30)], []
    for i in range(40):
        text = [word() for _ in range(60)] + piece + [word() for _ in range(60)]
        rows += [(3 * i + k, " ".join(text + [f"own{i}x{k}"])) for k in range(3)]
    made, unmet = [], substring.unmet
    monkeypatch.setattr(substring, "unmet", lambda *a: made.append(unmet(*a)) or made[-1])
    got = {r.doc_id: r for r in substring.group_passages(frame(spark, rows)).collect()}
    assert all(r.class_id == i // 3 * 3 and r.n_links == 2 for i, r in got.items())
    assert len(made) == 1 and made[0].count() == 0


def test_texts_with_short_pieces_in_common_are_left_out(spark):
    rng = random.Random(35)
    word = lambda: f"w{rng.randrange(10**9)}"
    piece, passage = [word() for _ in range(30)], [word() for _ in range(50)]
    rows = [(i, " ".join([word() for _ in range(40)] + (passage if i < 3 else piece) + [word() for _ in range(40)])) for i in range(60)] + [(60, "same " * 200), (61, "same " * 90), (62, "")]
    for parts in (1, 7):
        spread = spark.createDataFrame(rows, "node long, text string").repartition(parts)
        assert sorted(r.node for r in substring.shared_passages(spread).collect()) == [0, 1, 2, 60, 61]


def test_chains_of_one_word_keep_their_regions(spark):
    """Pairs left out of a chain of equal min-hashes lie inside pairs that stay, on the same offset."""
    texts = [(k, " ".join([f"own{k}x{i}" for i in range(30)] + ["same"] * n + [f"end{k % 2}x{i}" for i in range(40)])) for k, n in enumerate((60, 75, 90))]
    rows = substring.windows(spark.createDataFrame(texts, "node long, text string"))
    dealt = rows.unionAll(rows).repartition(3, "sig").sortWithinPartitions("sig", "node", "x")
    by = collections.defaultdict(list)
    for r in rows.collect():
        by[r.sig].append(r)
    every = set()
    for sig, held in by.items():
        for a in held:
            for b in held:
                left, right = min(a.x - a.l, b.x - b.l), min(a.r - a.x, b.r - b.x)
                if a.node < b.node and left + right + 1 >= substring.WIDTH:
                    every.add((a.node, b.node, sig & 3, a.x - b.x, a.x - left, a.x + right))
    pairs = spark.createDataFrame([(a, b, sig) for a, b in ((0, 1), (0, 2), (1, 2)) for sig in by], "a long, b long, sig long")
    found = substring.laid(pairs, rows.unionAll(rows)).collect()
    got = {(r.a, r.b, r.j, r.ax - r.bx, r.ax - r.left, r.ax + r.right) for r in found}
    assert len(got) == len(found) and got <= every and len(got) < len(every) / 2
    assert all(any(g[:4] == e[:4] and g[4] <= e[4] and e[5] <= g[5] for g in got) for e in every)
    # above ALL stretches only the first ones of a chain stay
    kept = substring.buckets(dealt).where("chunk <> -1")
    assert kept.count() and all(len(r.node) < 20 for r in kept.collect())


@pytest.mark.parametrize("copies", [40])
def test_links_of_an_edited_passage(spark, copies):
    """Links of a small group against brute force over all pairs."""
    rng = random.Random(33)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(copies):
        words = [w if rng.random() > 0.02 else f"new{i}x{k}" for k, w in enumerate(base)]
        rows.append((i, " ".join(f"own{i}x{k}" for k in range(40)) + " " + " ".join(words)))
    known = substring.word_hashes()
    cut = {i: substring.shingles(t.encode(), known) for i, t in rows}
    links = sum(1 for i in cut for j in cut if i != j and substring.alike_part(cut[i], cut[j]))
    got = substring.group_passages(frame(spark, rows)).collect()
    assert sum(r.n_links for r in got) >= 0.9 * links > 500


def slow_removal(rows, length=50):
    first = {}
    last = 1 << 62
    for doc, text in sorted(((last if d is None else d), (t or "").encode()) for d, t in rows):
        for i in range(len(text) - length + 1):
            first.setdefault(text[i : i + length], doc)
    out = collections.Counter()
    for doc, text in rows:
        raw, dead = (text or "").encode(), set()
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < (last if doc is None else doc):
                dead.update(range(i, i + length))
        spans = sum(1 for x in dead if x - 1 not in dead)
        kept = bytes(c for i, c in enumerate(raw) if i not in dead)
        out[doc, len(raw), len(dead), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeated_strings_are_exact(spark):
    rng = random.Random(8)
    rows = documents()[:70] + [(70, "é" * 60), (71, "xé" + "é" * 59), (72, "ab" * 80), (73, "b" + "ab" * 70), (74, "a" * 49), (75, "a" * 50), (76, "a" * 400), (77, "".join(rng.choice("ab") for _ in range(3000)))]
    got = collections.Counter(tuple(r) for r in runindex.dedup_substrings(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == slow_removal(rows)
    assert runindex.dedup_substrings(frame(spark, [])).count() == 0
    out = runindex.dedup_substrings(frame(spark, rows), with_text=True).where("doc_id = 76").first()
    assert bytes(out.kept) == b"" and [tuple(s) for s in out.spans] == [(0, 400)]


def test_run_index_matching_statistics():
    rng = random.Random(6)
    for _ in range(25):
        parts = list({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 25))).encode() for _ in range(12)})
        index = runindex.RunIndex(parts, max(map(len, parts)))
        joined = b"\0" + b"\0".join(parts) + b"\0"
        asked = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 20))).encode() for _ in range(10)]
        size, place = index.stream(asked, 60)
        flat, at = b"".join(asked), 0
        for q in asked:
            for i in range(len(q)):
                want = max(k for k in range(len(q) - i + 1) if q[i : i + k] in joined)
                assert size[at + i] == want
                assert joined[place[at + i] : place[at + i] + want] == flat[at + i : at + i + want]
            at += len(q)
