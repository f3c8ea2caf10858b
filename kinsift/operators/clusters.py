"""Clusters: connected components of pairs, their numbering, labels for all records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsift.operators.workspace import Workspace, dense_index

_MAX_ROUNDS = 100
#: Edges that one task may label at once, some 50 bytes each.
LOCAL_EDGES = 500_000


def build_graph(pairs: DataFrame) -> DataFrame:
    """Undirected edges u < v; repeated, reversed and self pairs merge or fall out, null ids link nothing."""
    src, dst = F.col("src_id").cast("long"), F.col("dst_id").cast("long")
    return pairs.select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).where("src_id is not null and dst_id is not null and src_id != dst_id").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and component of all edges of one task: the roots of both ends of an edge are joined and paths halved until nothing changes."""
    held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    if not held:
        return
    nodes, place = np.unique(np.concatenate(held, axis=1), return_inverse=True)
    u, v = place.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        low, new = np.minimum(label[u], label[v]), label.copy()
        for end in (u, v):
            np.minimum.at(new, label[end], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])


def connected_components(pairs: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """node and component (its smallest node) of each linked node: alternating large and small stars (Kiveris et al. 2014), logarithmic in practice.

    Up to local_edges distinct edges, which are counted, one task labels them all instead. Each round aggregates minima map-side and joins them back; the tables of a round are written to the shared folder, and adaptive
    skew joins split hubs.
    """
    space = Workspace(pairs.sparkSession, "components")
    edges = space.write(build_graph(pairs))
    state = _state(edges)
    if state[0] <= local_edges:
        return edges.coalesce(1).mapInArrow(_labels, "node long, component long")
    for _ in range(_MAX_ROUNDS):
        # large star: larger neighbours of a node are linked to its smallest neighbour
        both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select("v", "u"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("u"), F.col("b").alias("v")).where("u != v").distinct()
        # small star: a node and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        small = joined.select(F.col("m").alias("u"), F.col("u").alias("v")).union(joined.select("m", "v")).where("u != v").distinct()
        edges = space.write(small.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("the components did not converge")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(edges.select("u", "u").distinct())


def label_clusters(records: DataFrame, pairs: DataFrame, min_cluster_size: int = 2, id_column: str = "row_id") -> DataFrame:
    """records with cluster_id (bigint): components of min_cluster_size or more are 0, 1, ... in the order of the smallest src_id of their pairs; the other records follow, one each, in the order of their id."""
    space = Workspace(records.sparkSession, "clusters")
    nodes = space.write(connected_components(pairs))
    sizes = nodes.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_cluster_size).select("component")
    first = pairs.where("src_id is not null and dst_id is not null and src_id != dst_id").groupBy("src_id").agg(F.lit(1)).join(nodes, F.col("src_id") == F.col("node")).groupBy("component").agg(F.min("src_id").alias("first_src"))
    numbered = space.write(dense_index(sizes.join(first, "component"), "first_src", name="cluster_id").select("component", "cluster_id"))
    labels = nodes.join(numbered, "component").select(F.col("node").alias(id_column), "cluster_id")
    labelled = space.write(records.drop("cluster_id").join(labels, id_column, "left"))
    after = numbered.count()
    single = dense_index(labelled.where("cluster_id is null").select(id_column), id_column, name="cluster_id", start=after)
    return labelled.where("cluster_id is not null").unionByName(labelled.where("cluster_id is null").drop("cluster_id").join(single, id_column))
