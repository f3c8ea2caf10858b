"""Hyperplane-tree partitions: a tree learned from a sample, one partition or several (spill) for each vector."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinsift.functions.columns import dot


@dataclass
class Node:
    """An inner node has a hyperplane, the threshold (the median projection of its sample) and the spread of projections; a leaf has a partition_id."""

    partition_id: int = -1
    hyperplane: list[float] | None = None
    threshold: float = 0.0
    spread: float = 0.0
    left: Node | None = None
    right: Node | None = None

    @property
    def is_leaf(self) -> bool:
        return self.hyperplane is None


def _direction(x: np.ndarray) -> np.ndarray:
    """The second right singular vector (the first if there is but one), its largest entry positive."""
    values, vectors = np.linalg.eigh(x.T @ x)
    chosen = vectors[:, -2] if min(x.shape) > 1 else vectors[:, -1]
    return chosen * (1 if chosen[np.argmax(np.abs(chosen))] > 0 else -1)


def _grow(x: np.ndarray, level: int, max_depth: int, min_leaf: int) -> Node:
    if level >= max_depth or len(x) < min_leaf or len(x) < 2:
        return Node()
    h = _direction(x)
    p = x @ h
    threshold = float(np.median(p))
    left, right = x[p <= threshold], x[p > threshold]
    if not len(left) or not len(right):
        return Node()
    return Node(-1, h.tolist(), threshold, float(p.max() - p.min()), _grow(left, level + 1, max_depth, min_leaf), _grow(right, level + 1, max_depth, min_leaf))


def leaves(tree: Node) -> list[Node]:
    return [tree] if tree.is_leaf else [*(leaves(tree.left) if tree.left else []), *(leaves(tree.right) if tree.right else [])]


def leaf_count(tree: Node) -> int:
    return len(leaves(tree))


def number_leaves(tree: Node) -> Node:
    """Leaves numbered 0, 1, ... from left to right."""
    for k, leaf in enumerate(leaves(tree)):
        leaf.partition_id = k
    return tree


def sampled(df: DataFrame, vector: str, id_column: str, size: int, rows: int | None = None) -> np.ndarray:
    """At most size vectors, drawn evenly over all rows by a hash of the id (the same rows whatever the layout), as a matrix on the driver; null vectors don't count."""
    usable = df.where(F.col(vector).isNotNull() & F.col(id_column).isNotNull())
    n = usable.count() if rows is None else rows
    if n > size:
        every = 1 << 20
        usable = usable.where(F.pmod(F.xxhash64(F.lit(29), id_column), F.lit(every)) < int(every * size / n))
    taken = usable.select(F.col(vector).cast("array<float>").alias("v")).limit(size).toArrow()["v"].combine_chunks()
    return taken.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(taken), -1) if len(taken) else np.zeros((0, 0))


def depth_for(rows: int, leaf_rows: int = 4096) -> int:
    """The depth at which an even tree over so many rows has leaves of leaf_rows at most."""
    return max(0, math.ceil(math.log2(max(rows, 1) / leaf_rows)))


def learn_tree(df: DataFrame, vector: str = "normFeatures", order: str = "row_id", sample_size: int = 100_000, max_tree_depth: int | None = 6, min_leaf_size: int = 1000, head: bool = False) -> Node:
    """A tree learned from a bounded sample: drawn over all rows by a hash of the order column, or its first sample_size rows (head=True). Null vectors don't count.

    max_tree_depth=None takes the depth from the number of rows (depth_for), as far as min_leaf_size allows. Splits that leave a side
    empty are not made.
    """
    n = df.where(F.col(vector).isNotNull()).count() if max_tree_depth is None or not head else None
    if head:
        rows = df.where(F.col(vector).isNotNull()).orderBy(order).select(F.col(vector).cast("array<float>").alias("v")).limit(sample_size).toArrow()["v"].combine_chunks()
        x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))
    else:
        x = sampled(df, vector, order, sample_size, n)
    depth = depth_for(n or 0) if max_tree_depth is None else max_tree_depth
    return number_leaves(_grow(x, 0, depth, min_leaf_size) if len(x) else Node())


def _path(node: Node | None, v: Column) -> Column:
    if node is None:
        return F.lit(-1)
    if node.is_leaf:
        return F.lit(node.partition_id)
    side = dot(v, F.array(*map(F.lit, node.hyperplane))) <= F.lit(node.threshold)
    return F.when(v.isNull(), F.lit(-1)).when(side, _path(node.left, v)).otherwise(_path(node.right, v))


def _spill(node: Node | None, v: Column, alpha: float) -> Column:
    if node is None:
        return F.array().cast("array<int>")
    if node.is_leaf:
        return F.array(F.lit(node.partition_id))
    p = dot(v, F.array(*map(F.lit, node.hyperplane)))
    left, right = _spill(node.left, v, alpha), _spill(node.right, v, alpha)
    both = F.abs(p - F.lit(node.threshold)) <= F.lit(alpha * node.spread)
    return F.when(v.isNull(), F.array().cast("array<int>")).when(both, F.concat(left, right)).when(p <= F.lit(node.threshold), left).otherwise(right)


def flat_tree(tree: Node) -> tuple[np.ndarray, ...]:
    """The tree as plain arrays, which executors read without this package: left and right child (-1: none), leaf id (-1: inner node), threshold, spread and hyperplane of each node."""
    nodes: list[Node] = []

    def add(node: Node) -> int:
        nodes.append(node)
        place = len(nodes) - 1
        children.append([-1, -1])
        if not node.is_leaf:
            children[place] = [add(side) if side is not None else -1 for side in (node.left, node.right)]
        return place

    children: list[list[int]] = []
    add(tree)
    width = max((len(n.hyperplane) for n in nodes if n.hyperplane is not None), default=1)
    planes = np.array([n.hyperplane if n.hyperplane is not None else [0.0] * width for n in nodes])
    return np.array(children), np.array([n.partition_id if n.is_leaf else -1 for n in nodes]), np.array([n.threshold for n in nodes]), np.array([n.spread for n in nodes]), planes


def _walk(tree: tuple[np.ndarray, ...], x: np.ndarray, rows: np.ndarray, alpha: float | None) -> list[list[int]]:
    """The leaves that each row of x reaches."""
    children, leaf, threshold, spread, planes = tree
    into: list[list[int]] = [[] for _ in range(len(x))]
    work = [(0, rows)]
    while work:
        node, here = work.pop()
        if node < 0 or not len(here):
            continue
        if children[node][0] < 0 and children[node][1] < 0:
            for r in here if leaf[node] >= 0 else ():
                into[r].append(int(leaf[node]))
            continue
        p = x[here] @ planes[node]
        near = np.abs(p - threshold[node]) <= alpha * spread[node] if alpha is not None else np.zeros(len(p), bool)
        work.append((children[node][0], here[near | (p <= threshold[node])]))
        work.append((children[node][1], here[near | (p > threshold[node])]))
    return into


def _reached(df: DataFrame, tree: Node, vector: str, alpha: float | None, name: str) -> DataFrame:
    """By batches of rows, for trees too large for one expression."""
    shared = df.sparkSession.sparkContext.broadcast(flat_tree(tree))  # at most 2^(depth + 1) nodes of a tree that a bounded sample gave
    place = df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(place)
            rows = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
            into: list[list[int]] = [[] for _ in range(batch.num_rows)]
            if len(rows):
                flat = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
                x = np.zeros((batch.num_rows, flat.shape[1]))
                x[rows] = flat
                into = _walk(shared.value, x, rows, alpha)
            added = pa.array([w[0] if w else -1 for w in into], pa.int32()) if alpha is None else pa.array([sorted(w) for w in into], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, added], [*batch.schema.names, name])

    kind = T.IntegerType() if alpha is None else T.ArrayType(T.IntegerType())
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


#: Trees of up to so many leaves become one built-in expression.
EXPRESSION_LEAVES = 8


def assign_partition(df: DataFrame, tree: Node, vector: str = "normFeatures") -> DataFrame:
    """df with partition_id; -1 for a null vector or a missing side of the tree."""
    df = df.drop("partition_id")
    if leaf_count(tree) <= EXPRESSION_LEAVES:
        return df.withColumn("partition_id", _path(tree, F.col(vector)).cast("int"))
    return _reached(df, tree, vector, None, "partition_id")


def spill_partitions(df: DataFrame, tree: Node, alpha: float = 0.3, vector: str = "normFeatures") -> DataFrame:
    """df with queryPartitions, ascending: all partitions reached when projections within alpha times the spread of a threshold go both ways."""
    df = df.drop("queryPartitions")
    if leaf_count(tree) <= EXPRESSION_LEAVES:
        return df.withColumn("queryPartitions", F.array_sort(F.array_distinct(_spill(tree, F.col(vector), alpha))))
    return _reached(df, tree, vector, alpha, "queryPartitions")


def partition_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("partition_id").agg(F.count(F.lit(1)).alias("records")).orderBy("partition_id")


def spill_widths(df: DataFrame) -> DataFrame:
    """Records by the number of partitions that they are searched in."""
    return df.groupBy(F.size("queryPartitions").alias("width")).agg(F.count(F.lit(1)).alias("records")).orderBy("width")
