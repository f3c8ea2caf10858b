"""Cells of an inverted file: centroids learned from a sample, the cell of each vector and the nearest cells that it searches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Passes of the clustering, rows compared at once, and searches that the number of cells is set by.
PASSES, CHUNK, TRIALS = 10, 1024, 2000


def _scores(x: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """The greater the nearer."""
    return x @ c.T if metric == "cosine" else 2 * x @ c.T - (c * c).sum(1)[None]


def _prepared(x: np.ndarray, metric: str) -> np.ndarray:
    x = x.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if metric == "cosine" else x


def _nearest(x: np.ndarray, c: np.ndarray, metric: str, count: int) -> np.ndarray:
    """The count best rows of c for each row of x, best first, ties by the smaller place."""
    out = np.empty((len(x), count), np.int32)
    for at in range(0, len(x), CHUNK):
        s = -_scores(x[at : at + CHUNK], c, metric)
        near = np.argpartition(s, count - 1, axis=1)[:, :count] if count < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(s), 1))
        out[at : at + CHUNK] = np.take_along_axis(near, np.lexsort((near, np.take_along_axis(s, near, 1)), axis=1), 1)
    return out


def fit_cells(sample: np.ndarray, cells: int, k: int, recall: float, metric: str = "cosine", seed: int = 13) -> tuple[np.ndarray, int]:
    """Centroids, and how many of the nearest cells a search needs so that it finds this share of its k nearest within the sample.

    Neighbours within a sample are farther apart than those within all rows, so the number errs on the side of more cells.
    """
    if cells <= 1 or len(sample) <= max(k, cells):
        return np.zeros((1, sample.shape[1] if sample.size else 1), np.float32), 1
    x, rng = _prepared(sample, metric), np.random.default_rng(seed)
    centres = x[rng.choice(len(x), cells, False)]
    for _ in range(PASSES):
        own = _nearest(x, centres, metric, 1)[:, 0]
        size = np.bincount(own, minlength=cells)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        # an empty cell takes a row of its own
        total[size == 0] = x[rng.choice(len(x), int((size == 0).sum()))]
        centres = _prepared(total / np.maximum(size, 1)[:, None], metric)
    own = _nearest(x, centres, metric, 1)[:, 0]
    asked = rng.choice(len(x), min(TRIALS, len(x)), False)
    near = _nearest(x[asked], x, metric, min(k + 1, len(x)))
    order = np.argsort(np.argsort(-_scores(x[asked], centres, metric), axis=1, kind="stable"), axis=1)
    # the place, in the order of a search's cells, at which each true neighbour is met
    place = np.take_along_axis(order, own[near], 1)[near != asked[:, None]]
    return centres, int(np.ceil(np.quantile(place, recall))) + 1


def place_in_cells(rows: DataFrame, cells: tuple[np.ndarray, int], metric: str = "cosine", vector: str = "v") -> DataFrame:
    """rows with partition_id (the nearest cell) and queryPartitions (the cells to search, nearest first). vector is not null."""
    shared = rows.sparkSession.sparkContext.broadcast(cells)  # centroids of a bounded sample
    place, kinds = rows.columns.index(vector), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, searched = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(place).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if len(centres) == 1:
                near = np.zeros((len(x), 1), np.int32)
            else:
                near = _nearest(_prepared(x, metric), centres, metric, min(searched, len(centres)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near[:, 0]), lists], [*batch.schema.names, "partition_id", "queryPartitions"])

    return rows.mapInArrow(run, f"{kinds}, partition_id int, queryPartitions array<int>")
