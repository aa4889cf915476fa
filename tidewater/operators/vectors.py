"""An inverted file of vectors: cells around centres, stored apart, searched exactly.

Vectors are taken by direction. Each lies in the cell of its nearest centre; a cell knows how far its
farthest vector is. By the triangle inequality no vector of a cell is nearer to a query than the centre's
distance less that radius, so that a search reads the likeliest cells first and then only those that could
still hold one of the k nearest: the result is that of a full scan.

Cases: null, empty and zero vectors, and vectors of another dimension, are not indexed and never found; equal scores go by id;
fewer rows than k give all; one cell with very many rows is several files; an empty table has no cells.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.retrieve import with_score
from tidewater.operators.tables import Folder

#: Centres are fitted on at most so many vectors; every vector is indexed.
SAMPLE_ROWS = 20_000
#: Cells are at most so many (their centres are held in each task), else about the square root of the rows.
MOST_CELLS = 4096
#: Rows of one file of a cell, about.
FILE_ROWS = 200_000
#: Distances are compared with this much room for rounding.
SLACK = 1e-6


def _matrix(column: pa.Array, dimensions: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a list column, and which rows have one."""
    lengths = np.diff(column.offsets.to_numpy())
    good = np.asarray(column.is_valid()) & (lengths > 0)
    d = dimensions or (int(lengths[good][0]) if good.any() else 0)
    good &= lengths == d
    flat = column.filter(pa.array(good)).flatten()
    values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d) if d else np.zeros((0, 0))
    norm = np.sqrt((values * values).sum(1))
    fine = np.isfinite(norm) & (norm > 0)
    good[np.flatnonzero(good)[~fine]] = False
    return values[fine] / norm[fine, None], good


def nearest_centre(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the nearest centre of each unit vector, some thousand vectors at a time."""
    parts = [(points[s : s + 4096] @ centres.T).argmax(1) for s in range(0, len(points), 4096)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def fit_centres(rows: DataFrame, cells: int, sample_rows: int = SAMPLE_ROWS, rounds: int = 8) -> np.ndarray:
    """Centres of the sampled vectors: those of least hash, farthest-first starts, then rounds of means."""
    picked = rows.select("id", "embedding").where("embedding is not null").orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow()
    if not picked.num_rows:
        return np.zeros((0, 0))
    points, _ = _matrix(picked.column("embedding").combine_chunks())
    if not len(points):
        return np.zeros((0, 0))
    centres, apart = [points[0]], np.full(len(points), np.inf)
    while len(centres) < min(cells, len(points)):
        apart = np.minimum(apart, 2 - 2 * points @ centres[-1])
        if apart.max() <= 1e-12:
            break
        centres.append(points[int(apart.argmax())])
    centres = np.array(centres)
    for _ in range(rounds):
        near = nearest_centre(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
    return centres


class VectorIndex:
    """Rows of a table by cell, under a folder, with a small file of centres, radii and counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.folder = spark, root.rstrip("/"), Folder(spark, root)
        held = json.loads(self.folder.text("cells.json"))
        self.schema = held["schema"]
        self.cells = held["cells"]
        self.centres = np.array([c["centre"] for c in self.cells]) if self.cells else np.zeros((0, 0))

    @classmethod
    def build(cls, rows: DataFrame, root: str, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> VectorIndex:
        """Index every row of `rows` (with `id` and `embedding`, and any other columns)."""
        spark, root = rows.sparkSession, root.rstrip("/")
        count = rows.count()
        cells = min(MOST_CELLS, cells or max(1, round(count**0.5)))
        centres = fit_centres(rows, cells, sample_rows)
        names = rows.columns
        held = spark.sparkContext.broadcast(centres)  # at most MOST_CELLS vectors

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = held.value
            for batch in batches:
                column = batch.column("embedding")
                points, good = _matrix(column, at.shape[1])
                if not len(points):
                    continue
                near = nearest_centre(points, at)
                far = np.sqrt(((points - at[near]) ** 2).sum(1))
                kept = batch.filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(near.astype(np.int32)), pa.array(far)], [*names, "cell", "far"])

        table = f"{root}/rows"
        if len(centres):
            schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", cell int, far double"
            placed = rows.mapInArrow(assign, schema)
            parts = max(1, -(-count // FILE_ROWS))
            # a large cell is spread over several tasks and files
            placed.repartition(max(parts, min(len(centres), 64)), "cell", F.pmod(F.xxhash64("id"), F.lit(parts))).write.partitionBy("cell").parquet(table)
            stored = spark.read.schema(schema).parquet(table)
            facts = {r["cell"]: r for r in stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}  # a row for each cell
        else:
            facts = {}
        made = [{"cell": int(c), "n": facts[c]["n"], "radius": facts[c]["radius"], "centre": centres[c].tolist()} for c in sorted(facts)]
        folder = Folder(spark, root)
        folder.put("cells.json", json.dumps({"schema": ", ".join(f"`{n}` {t}" for n, t in rows.dtypes), "cells": made}))
        return cls(spark, root)

    def read(self, cells: list[int]) -> DataFrame:
        """The rows of some cells: other cells' folders are not opened."""
        if not cells:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema + ", cell int").option("basePath", f"{self.root}/rows").parquet(*[f"{self.root}/rows/cell={c}" for c in cells])
        return rows.drop("cell")

    def bounds(self, query: list[float]) -> np.ndarray:
        """For each cell, a distance that none of its vectors is below."""
        q = np.asarray(query, np.float64)
        q = q / np.linalg.norm(q)
        return np.maximum(0, np.sqrt(np.maximum(0, ((self.centres - q) ** 2).sum(1))) - np.array([c["radius"] for c in self.cells]) - SLACK)

    def search(self, query: list[float], k: int = 8, where=None) -> tuple[DataFrame, list[int]]:
        """The k rows nearest by cosine, among those that `where` takes, with `exact` and `score`; and the cells read for them.

        Cells come nearest bound first until k rows are found; the k-th distance then says which others may
        hold a nearer one.
        """
        if not self.cells or not np.linalg.norm(query):
            return self.spark.createDataFrame([], self.schema + ", exact double, score double"), []
        low = self.bounds(query)
        order = np.argsort(low, kind="stable")
        counts = np.array([c["n"] for c in self.cells])[order]
        take = int(np.searchsorted(np.cumsum(counts), k)) + 1
        while True:
            take = min(take, len(order))
            best = self._best(order[:take], query, k, where).select("exact").collect()  # at most k rows
            if len(best) == k or take == len(order):
                break
            take *= 2
        if len(best) == k:
            kth = np.sqrt(max(0.0, 2 - 2 * best[-1]["exact"]))
            take = max(take, int(np.searchsorted(low[order], kth + SLACK, "right")))
        return self._best(order[:take], query, k, where), [self.cells[i]["cell"] for i in order[:take]]

    def _best(self, which: np.ndarray, query: list[float], k: int, where) -> DataFrame:
        rows = self.read([self.cells[i]["cell"] for i in which])
        rows = rows if where is None else rows.where(where)
        return with_score(rows, query).orderBy(F.desc("exact"), "id").limit(k)
