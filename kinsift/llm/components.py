"""Consolidating pairwise matches into groups (problem 3): union-find over edge partitions, merged level by level.

Each level counts its edges and spreads them over as many partitions as the bound asks for (by a hash of the whole edge, so a node that
occurs in a third of all edges makes no hot partition). A partition runs union-find and keeps only a spanning forest, as stars from each node to the local
root. Nodes that are root in no partition then retire: they keep a pointer to one local root, and their other stars become edges
between roots. So the forest shrinks from level to level by at least the retired nodes, and levels use fewer partitions, until the
rest fits one bounded partition: the last level takes a single task only once its edges are within the bound. Roots are chosen by a hash that changes with the level, so of n nodes with mean degree d about
n/(d+1) or more retire in each level, whatever the shape (chains, stars). At the end the pointers are followed back, level by level,
and each group gets its smallest member.

Nulls, self-pairs and repeated or reversed pairs link nothing new. Without pairs the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, parallelism, table

#: Edges that one partition takes, at about 100 bytes of working memory an edge.
EDGES_PER_PARTITION = 1_000_000
_MAX_LEVELS = 60
#: The first level uses further partitions, up to the usual parallelism, while they would hold so many edges.
SMALL_EDGES = 50_000


def partitions_for(edges: int, bound: int) -> int:
    """Partitions over which a hash spreads the edges so that none gets more than the bound: the mean leaves six standard deviations of room (at most half, for very small bounds)."""
    if edges <= bound:
        return 1
    return -(-edges // max(1, bound // 2, int(bound - 6 * bound**0.5)))


def _mix(ids: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash that orders the nodes of a level; a bijection, so there are no ties."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def union_find(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, for nodes 0..n-1: batched unions to the smaller root, then path compression."""
    parent = np.arange(n)
    while len(u):
        low, high = np.minimum(u, v), np.maximum(u, v)
        np.minimum.at(parent, high, low)
        while True:
            grand = parent[parent]
            if np.array_equal(grand, parent):
                break
            parent = grand
        u, v = parent[low], parent[high]
        apart = u != v
        u, v = u[apart], v[apart]
    return parent


def _forest(level: int, batch_edges: int):
    """Stars of a partition's spanning forest as (node, root); each root also comes once as (root, null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stars = np.zeros((2, 0), np.int64)
        waiting: list[np.ndarray] = []

        def fold(stars: np.ndarray) -> np.ndarray:
            edges = np.concatenate([stars, *waiting], axis=1)
            waiting.clear()
            nodes = np.unique(edges)
            nodes = nodes[np.argsort(_mix(nodes, level))]
            order = np.argsort(nodes)
            at = order[np.searchsorted(nodes, edges, sorter=order)]
            root = union_find(at[0], at[1], len(nodes))
            member = np.flatnonzero(root != np.arange(len(nodes)))
            return np.stack([nodes[member], nodes[root[member]]])

        for batch in batches:
            waiting.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            if sum(w.shape[1] for w in waiting) >= batch_edges:
                stars = fold(stars)
        if waiting:
            stars = fold(stars)
        if stars.shape[1]:
            roots = np.unique(stars[1])
            node = np.concatenate([stars[0], roots])
            root = pa.array(np.concatenate([stars[1], roots]), mask=np.arange(len(node)) >= stars.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(node), root], ["node", "root"])

    return run


def connected_components(edges: DataFrame, src: str = "src_id", dst: str = "dst_id", edges_per_partition: int = EDGES_PER_PARTITION, workspace: Workspace | None = None) -> DataFrame:
    """One row per node that an edge links to another one: node, component (the smallest node of its component)."""
    spark: SparkSession = edges.sparkSession
    space = workspace or Workspace(spark, "components")
    u, v = F.col(src).cast("long"), F.col(dst).cast("long")
    active = space.write(edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).where(u.isNotNull() & v.isNotNull() & (u != v)))
    known, pointers = active.count(), []  # known: edges of this level
    for level in range(_MAX_LEVELS):
        parts = partitions_for(known, edges_per_partition)
        if parts == 1 and level == 0:
            parts = min(parallelism(spark), max(1, known // SMALL_EDGES))  # enough work for several tasks, though one could hold it
        spread = active.repartition(parts, "u", "v") if parts > 1 else active.coalesce(1)
        stars = space.write(spread.mapInArrow(_forest(level, edges_per_partition), "node long, root long"))
        if parts == 1:
            pointers.append(stars.where("root is not null").select("node", F.col("root").alias("up")))
            tops = stars.where("root is null").select("node", F.col("node").alias("top"))
            break
        # a node has at most one star in each partition, so its set is bounded by their number
        node = stars.groupBy("node").agg(F.min("root").alias("up"), F.max(F.col("root").isNull()).alias("is_root"), F.collect_set("root").alias("roots"))
        node = space.write(node)
        pointers.append(node.where("not is_root").select("node", "up"))
        between = node.select("node", "up", "is_root", F.explode("roots").alias("root")).where("is_root or root != up")
        other = F.when(F.col("is_root"), F.col("node")).otherwise(F.col("up"))
        rest = space.write(between.select(F.least("root", other).alias("u"), F.greatest("root", other).alias("v")).distinct())
        known = rest.count()
        if known == 0:
            tops = node.where("is_root").select("node", F.col("node").alias("top"))
            break
        # roots without a further edge are the tops of finished components
        ends = rest.select("u").union(rest.select("v")).distinct()
        finished = node.where("is_root").join(ends, node.node == ends.u, "left_anti").select("node", F.col("node").alias("up"))
        pointers[-1] = pointers[-1].union(finished)
        active = rest
    else:
        raise RuntimeError("the components did not converge")
    labels = tops
    for up in reversed(pointers):
        # a finished root points to itself; it is its own top
        own = up.where("node = up").select("node", F.col("up").alias("top"))
        above = labels.union(own)
        below = up.where("node != up")
        labels = above.union(below.join(above.withColumnRenamed("node", "up"), "up").select("node", "top"))
    labels = space.write(labels)
    smallest = labels.groupBy("top").agg(F.min("node").alias("component"))
    return labels.join(smallest, "top").select("node", "component")


def group_records(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """row_id and group_id of each record that the pairs link to another record. Ids that are no record link nothing."""
    space = Workspace(pairs.sparkSession, "groups")
    ids = records.select(F.col("row_id").alias("id")).where("id is not null").distinct()
    links = pairs.select(F.least("src_id", "dst_id").alias("u"), F.greatest("src_id", "dst_id").alias("v")).where("src_id is not null and dst_id is not null and src_id != dst_id").distinct()
    links = links.join(ids, links.u == ids.id, "left_semi").join(ids, links.v == ids.id, "left_semi")
    found = connected_components(links, "u", "v", workspace=space)
    return found.select(F.col("node").alias("row_id"), F.col("component").alias("group_id"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_records(table(spark, sf_dir, "candidate_pairs"), table(spark, sf_dir, "results"))
