"""k nearest neighbours: exact in blocks, exact as one expression (the specification), and approximate over spilled tree partitions or the cells of centroids."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinsift.functions.columns import dot, norm
from kinsift.operators.cells import fit_cells, place_in_cells
from kinsift.operators.partitioning import Node, assign_partition, sampled, spill_partitions
from kinsift.operators.workspace import Workspace

#: Rows of a block of stored and of searching vectors; distances are ranked at this many decimals, ties by the smaller id.
POINT_BLOCK, QUERY_BLOCK, DECIMALS = 4096, 8192, 9
#: Below this squared L2 or cosine distance a neighbour counts as a duplicate for drop_zero_distance.
ZERO_DISTANCE = 1e-6
#: Rows that a cell of centroid_knn should hold.
CELL_ROWS = 1024


def _distances(q: np.ndarray, p: np.ndarray, metric: str) -> np.ndarray:
    if metric == "sqeuclidean":
        return np.maximum((q * q).sum(1)[:, None] - 2 * q @ p.T + (p * p).sum(1)[None], 0)
    nq, np_ = np.linalg.norm(q, axis=1), np.linalg.norm(p, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (q / np.where(nq > 0, nq, 1)[:, None]) @ (p / np.where(np_ > 0, np_, 1)[:, None]).T
    return 1 - s


def _searcher(k: int, metric: str, drop_zero: bool):
    def run(group: pa.Table) -> pa.Table:
        role, ids = group["role"].to_numpy(), group["id"].to_numpy()
        x = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        order = np.argsort(ids[role == 0], kind="stable")
        p, pid = x[role == 0][order], ids[role == 0][order]
        q, qid = x[role == 1], ids[role == 1]
        out: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(q) if len(p) else 0, 256):
            d = np.round(_distances(q[at : at + 256], p, metric), DECIMALS) + 0.0
            mine = qid[at : at + 256]
            d[mine[:, None] == pid[None]] = np.inf
            if drop_zero:
                d[d <= ZERO_DISTANCE] = np.inf
            # stored rows are in order of id, so a stable sort breaks ties by id
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            near = np.take_along_axis(d, best, 1)
            row, col = np.nonzero(np.isfinite(near))
            out.append((mine[row], pid[best[row, col]], near[row, col]))
        src, dst, far = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"src_id": src, "dst_id": dst, "distance": far})

    return run


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("src_id").orderBy("distance", "dst_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_knn(df: DataFrame, k: int = 20, vector: str = "normFeatures", id_column: str = "row_id", metric: str = "cosine", drop_zero_distance: bool = False, point_block: int = POINT_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """src_id, dst_id, distance, rank of the k nearest of each row, itself left out. Null vectors take no part; a zero vector has cosine distance 1.

    Every row searches all rows, block against block, each pair of blocks in one task: the work grows with the square of the rows, so
    use approx_knn beyond some 100,000 rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    n = rows.count()
    stored = max(1, math.ceil(n / point_block))
    asking = max(1, math.ceil(n / query_block), math.ceil(min(spark.sparkContext.defaultParallelism, n / 256) / stored))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    block = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    points = rows.select(block(stored).alias("pb"), every(asking).alias("qb"), F.lit(0).alias("role"), "id", "v")
    queries = rows.select(every(stored).alias("pb"), block(asking).alias("qb"), F.lit(1).alias("role"), "id", "v")
    found = points.unionByName(queries).groupBy("pb", "qb").applyInArrow(_searcher(k, metric, drop_zero_distance), "src_id long, dst_id long, distance double")
    return _ranked(found, k)


def exact_knn_expression(df: DataFrame, k: int = 20, vector: str = "normFeatures", id_column: str = "row_id", metric: str = "cosine") -> DataFrame:
    """The same in built-in expressions over all pairs; the specification for tests on small tables."""
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    a, b = rows.select(F.col("id").alias("src_id"), F.col("v").alias("a")), rows.select(F.col("id").alias("dst_id"), F.col("v").alias("b"))
    if metric == "sqeuclidean":
        distance = dot(F.zip_with("a", "b", lambda x, y: x.cast("double") - y), F.zip_with("a", "b", lambda x, y: x.cast("double") - y))
    else:
        size = norm(F.col("a")) * norm(F.col("b"))
        distance = 1 - F.coalesce(F.try_divide(dot(F.col("a"), F.col("b")), size), F.lit(0.0))
    pairs = a.join(b, F.col("src_id") != F.col("dst_id")).select("src_id", "dst_id", F.round(distance, DECIMALS).alias("distance"))
    return _ranked(pairs, k)


def cell_knn(placed: DataFrame, k: int = 20, metric: str = "cosine", point_block: int = POINT_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Neighbours of placed rows: id, v, partition_id (where a row is stored) and queryPartitions (where it searches). Partitions larger than a block are cut into blocks, so no task holds more than one block of either kind. placed is read several times: write it first."""
    # one row for each partition, and there are no more of them than the index has
    sizes = placed.groupBy(F.col("partition_id").alias("p")).agg(F.count(F.lit(1)).alias("stored")).join(placed.select(F.explode("queryPartitions").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("asked")), "p").where((F.col("stored") > point_block) | (F.col("asked") > query_block)).collect()
    stored, asked = {r.p: math.ceil(r.stored / point_block) for r in sizes}, {r.p: math.ceil(r.asked / query_block) for r in sizes}
    number = lambda d, c: F.coalesce(F.create_map(*[x for i, m in d.items() for x in (F.lit(i), F.lit(m))])[F.col(c)], F.lit(1)) if d else F.lit(1)
    points = placed.select(F.col("partition_id").alias("p"), "id", "v").select("p", F.pmod(F.xxhash64("id"), number(stored, "p")).cast("int").alias("pb"), F.explode(F.sequence(F.lit(0), number(asked, "p") - 1)).alias("qb"), F.lit(0).alias("role"), "id", "v")
    queries = placed.select(F.explode("queryPartitions").alias("p"), "id", "v").select("p", F.explode(F.sequence(F.lit(0), number(stored, "p") - 1)).alias("pb"), F.pmod(F.xxhash64("id"), number(asked, "p")).cast("int").alias("qb"), F.lit(1).alias("role"), "id", "v")
    found = points.unionByName(queries).groupBy("p", "pb", "qb").applyInArrow(_searcher(k, metric, False), "src_id long, dst_id long, distance double")
    return _ranked(found, k)


def approx_knn(df: DataFrame, tree: Node, k: int = 20, alpha: float = 0.3, vector: str = "normFeatures", id_column: str = "row_id", metric: str = "cosine", point_block: int = POINT_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Neighbours within the tree partitions that a row spills to; rows are stored in one partition."""
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    placed = Workspace(df.sparkSession, "tree").write(assign_partition(spill_partitions(rows, tree, alpha, "v"), tree, "v"))
    return cell_knn(placed, k, metric, point_block, query_block)


def centroid_knn(df: DataFrame, k: int = 20, recall: float = 0.95, vector: str = "normFeatures", id_column: str = "row_id", metric: str = "cosine", cell_rows: int = CELL_ROWS, sample_size: int = 24_000, point_block: int = POINT_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Neighbours by an inverted file: rows are stored in the cell of their nearest centroid and search as many of the nearest cells as the sample needed for this recall.

    Centroids and the number of cells to search come from a bounded sample drawn over all rows; the number of cells follows the row
    count, so a search looks at about the same number of rows at any size until the sample gives no more cells (sample_size / 8).
    """
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    n = rows.count()
    sample = sampled(rows, "v", "id", sample_size, n)
    cells = fit_cells(sample, max(1, min(round(n / cell_rows), len(sample) // 8)), k, recall, metric)
    placed = Workspace(df.sparkSession, "cells").write(place_in_cells(rows, cells, metric))
    return cell_knn(placed, k, metric, point_block, query_block)


def nest_neighbors(ranked: DataFrame, id_column: str = "row_id") -> DataFrame:
    """One row per source: neighbors as array of (neighbor, distance), nearest first; at most k each."""
    packed = F.array_sort(F.collect_list(F.struct("rank", F.col("dst_id").alias("neighbor"), "distance")))
    return ranked.groupBy("src_id").agg(F.transform(packed, lambda x: F.struct(x["neighbor"].alias("neighbor"), x["distance"].alias("distance"))).alias("neighbors")).withColumnRenamed("src_id", id_column)


def attach_neighbors(df: DataFrame, neighbors: DataFrame, id_column: str = "row_id", to: str = "neighbors") -> DataFrame:
    """df LEFT JOIN neighbors on the id column."""
    return df.join(neighbors.withColumnRenamed("neighbors", to), id_column, "left")


@dataclass
class NearestNeighbors:
    """Settings of a search; fit gives a model over a table. drop_zero_distance leaves out duplicates."""

    k: int = 30
    vector: str = "normFeatures"
    id_column: str = "row_id"
    metric: str = "cosine"
    drop_zero_distance: bool = False
    prediction_col: str = "neighbors"

    def fit(self, df: DataFrame) -> NearestNeighborsModel:
        return NearestNeighborsModel(self, df)


@dataclass
class NearestNeighborsModel:
    settings: NearestNeighbors
    table: DataFrame

    def neighbors(self) -> DataFrame:
        """Only the id and neighbors of each fitted row."""
        s = self.settings
        return nest_neighbors(exact_knn(self.table, s.k, s.vector, s.id_column, s.metric, s.drop_zero_distance), s.id_column)

    def transform(self, df: DataFrame) -> DataFrame:
        return attach_neighbors(df, self.neighbors(), self.settings.id_column, self.settings.prediction_col)
