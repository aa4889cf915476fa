"""The inverted file finds what a scan finds, and reads fewer cells for it."""

import random

import pytest

from tidewater.operators import retrieve
from tidewater.operators.vectors import VectorIndex


def clustered(seed, n, d=8, groups=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(groups)]
    return [[x + rng.gauss(0, 0.15) for x in rng.choice(centres)] for _ in range(n)]


SCHEMA = "id string, brand string, embedding array<float>"


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    vectors = clustered(1, 600)
    made = [(f"i{k}", f"B{k % 3}", v) for k, v in enumerate(vectors)] + [(f"c{k}", "hot", vectors[0]) for k in range(300)]
    made += [("null", "B0", None), ("empty", "B0", []), ("zero", "B0", [0.0] * 8), ("short", "B0", [1.0, 2.0]), ("odd", "B0", [float("nan")] * 8)]
    rows = spark.createDataFrame(made, SCHEMA).repartition(3).cache()
    return rows, VectorIndex.build(rows, str(tmp_path_factory.mktemp("index")) + "/v", cells=12)


def scan(rows, query, k, where="true"):
    good = retrieve.with_score(rows.where("size(embedding) = 8").where(where), query).where("not isnan(exact)")
    return [(r.id, r.score) for r in sorted(good.collect(), key=lambda r: (-r.exact, r.id))[:k]]


@pytest.mark.parametrize("k", [1, 8, 50])
def test_search_equals_the_scan(indexed, k):
    rows, index = indexed
    for query in (*clustered(1, 2), clustered(9, 1)[0], [1.0] + [0.0] * 7):
        found, read = index.search(query, k)
        assert [(r.id, r.score) for r in found.collect()] == scan(rows, query, k)
        assert len(read) <= len(index.cells)


def test_far_cells_are_not_read(indexed):
    rows, index = indexed
    query = rows.where("id = 'i1'").first().embedding
    found, read = index.search(query, 3)
    assert found.first().id == "i1" and len(read) <= len(index.cells) // 2
    assert sum(c["n"] for c in index.cells) == 900  # every row that has a vector


def test_filters_and_few_rows(indexed):
    rows, index = indexed
    query = clustered(4, 1)[0]
    for where in ("brand = 'B1'", "brand = 'hot'", "id = 'i7'", "false"):
        found, _ = index.search(query, 5, where)
        assert [(r.id, r.score) for r in found.collect()] == scan(rows, query, 5, where)
    assert index.search([0.0] * 8, 3)[0].count() == 0


def test_ties_go_by_id(indexed):
    rows, index = indexed
    query = rows.where("id = 'c0'").first().embedding
    found = [r.id for r in index.search(query, 10)[0].collect()]
    assert found == sorted(found)[:10] and set(found) <= {f"c{k}" for k in range(300)} | {"i0"}


def test_no_vectors(spark, tmp_path):
    for n, made in enumerate(([], [("a", "b", None)])):
        index = VectorIndex.build(spark.createDataFrame(made, SCHEMA), str(tmp_path / f"e{n}"))
        assert index.cells == [] and index.search([1.0], 3)[0].count() == 0
