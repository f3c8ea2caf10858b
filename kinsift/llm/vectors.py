"""The most similar vectors for every vector, over learned partitions (problem 5).

The index is fitted on a bounded sample: its neighbour graph is partitioned into balanced parts (principal splits, then moves of
nodes to the part of most of their neighbours while capacity lasts), and a softmax classifier is trained to tell the parts in which
a vector's neighbours lie. Every vector is stored in its most probable part and searches as many parts, most probable first, as
hold PROBED of the probability. Parts that are often searched together form an area, and a vector is sent once to each area that it
needs, both to be found and to search. Areas with many vectors or many searches are split into blocks, each block of vectors against each
block of searches, so no task holds more than a block of either. In a block the candidates are found by matrix products and
reranked in double precision; cosines are rounded to nine decimals and ties go to the smaller row_id. The number of parts grows
with the table, so the work for one vector stays about the same.

Equal vectors form one class and search once; each class keeps its smallest row_ids, enough for the nearest ones of every member, so
a third of all rows with one vector makes no hot group. A vector is usable if it has DIMENSIONS finite numbers, not all zero; others
are left out, like nulls. A row_id counts once (with its smallest vector). A record among fewer than k others has them all. Fewer than
two usable vectors give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, parallelism, table

K, DIMENSIONS = 10, 64
#: Vectors a part should hold, and of the sample for each part; the sample's bound.
PART_SIZE, SAMPLE_PER_PART, SAMPLE_BOUND = 512, 48, 24_000
#: A search covers parts until they hold this share of the classifier's probability, within these numbers of parts.
PROBED, LEAST_PARTS, MOST_PARTS = 0.995, 3, 12
#: Vectors and searches of one block.
POINT_BLOCK, QUERY_BLOCK = 4096, 16384
_CHUNK = 512


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of each row, itself left out, by inner product."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int32)
    for i in range(0, len(x), _CHUNK):
        s = x[i : i + _CHUNK] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + _CHUNK] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.15, passes: int = 6) -> np.ndarray:
    """Labels of a balanced partition of the neighbour graph."""
    label = np.zeros(len(x), np.int64)
    work = [(np.arange(len(x)), 0, parts)]
    while work:
        rows, first, count = work.pop()
        if count == 1 or len(rows) < 2:
            label[rows] = first
            continue
        y = x[rows] - x[rows].mean(0)
        direction = np.linalg.eigh(y.T @ y)[1][:, -1]
        left = count // 2
        order = np.argsort(y @ direction, kind="stable")
        at = len(rows) * left // count
        work += [(rows[order[:at]], first, left), (rows[order[at:]], first + left, count - left)]
    capacity = math.ceil(slack * len(x) / parts)
    size = np.bincount(label, minlength=parts)
    rng = np.random.default_rng(3)
    for _ in range(passes):
        moved = 0
        for i in rng.permutation(len(x)):
            near = label[graph[i]]
            kinds, votes = np.unique(near, return_counts=True)
            now = votes[kinds == label[i]].sum()
            for j in np.argsort(-votes):
                if votes[j] <= now:
                    break
                if size[kinds[j]] < capacity:
                    size[label[i]] -= 1
                    label[i] = kinds[j]
                    size[label[i]] += 1
                    moved += 1
                    break
        if moved < 0.005 * len(x):
            break
    return label


def train_router(x: np.ndarray, graph: np.ndarray, label: np.ndarray, parts: int, epochs: int = 24, batch: int = 256, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a softmax classifier whose targets are the parts of a vector and its neighbours."""
    rng = np.random.default_rng(seed)
    centres = np.stack([x[label == p].mean(0) if (label == p).any() else np.zeros(x.shape[1]) for p in range(parts)]).astype(np.float32)
    spread = max(1e-6, float(np.mean((x - centres[label]) ** 2)))
    w = (centres / spread / 2).T.astype(np.float32)
    b = (-(centres**2).sum(1) / spread / 4).astype(np.float32)
    first_w, second_w, first_b, second_b = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    rate, step = 0.02 * float(np.abs(w).mean() + 1e-3), 0
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            z = x[rows] @ w + b
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            near = np.concatenate([label[rows][:, None], label[graph[rows]]], 1)
            np.subtract.at(z, (np.arange(len(rows))[:, None], near), 1.0 / near.shape[1])
            gw, gb = x[rows].T @ z / len(rows), z.mean(0)
            step += 1
            scale = rate * (1 - epoch / epochs) * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, m, v, s in ((w, gw, first_w, second_w, 1.0), (b, gb, first_b, second_b, 1.0)):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= s * scale * m / (np.sqrt(v) + 1e-8)
    return w, b


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of float32 bytes as unit vectors in double precision."""
    x = np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), DIMENSIONS).astype(np.float64)
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row_id, v (array<float>) to row_id, v (bytes)."""
    for batch in batches:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, DIMENSIONS)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["row_id", "v"])


def fit_index(sample: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, weights and biases of the router."""
    mean = sample.mean(0)
    x = sample - mean
    unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    x = x.astype(np.float32)
    if parts <= 1 or len(x) <= K:
        return mean.astype(np.float32), np.zeros((x.shape[1], 1), np.float32), np.zeros(1, np.float32)
    graph = neighbour_graph(unit, K)
    label = balanced_parts(x, graph, parts)
    return (mean.astype(np.float32), *train_router(x, graph, label, parts))


def _probed(x: np.ndarray, mean: np.ndarray, w: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most probable parts of each vector, and which of them it searches."""
    z = (x - mean).astype(np.float32) @ w + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    count = min(most, p.shape[1])
    top = np.argpartition(-p, count - 1, axis=1)[:, :count]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(p, top, 1), axis=1, kind="stable"), 1)
    share = np.cumsum(np.take_along_axis(p, top, 1), 1)
    return top, np.c_[np.ones(len(p), bool), share[:, :-1] < PROBED] | (np.arange(count) < LEAST_PARTS)


def group_parts(sample: np.ndarray, router: tuple[np.ndarray, np.ndarray, np.ndarray], width: int) -> np.ndarray:
    """The area of each part: the two areas that most vectors of the sample search together are joined, while no more than width parts come together."""
    parts = router[1].shape[1]
    area, size = np.arange(parts), np.ones(parts, np.int64)
    if width <= 1:
        return area
    top, used = _probed(sample, *router, MOST_PARTS)
    both = np.zeros((parts, parts), np.float32)
    for i in range(0, len(sample), _CHUNK):
        asked = np.zeros((len(top[i : i + _CHUNK]), parts), np.float32)
        rows, places = np.nonzero(used[i : i + _CHUNK])
        asked[rows, top[i : i + _CHUNK][rows, places]] = 1
        both += asked.T @ asked
    np.fill_diagonal(both, 0)
    open_pairs = both.copy()
    while True:
        i, j = np.unravel_index(open_pairs.argmax(), both.shape)
        if open_pairs[i, j] <= 0:
            break
        area[area == j] = i
        both[i] += both[j]
        both[:, i] = both[i]
        both[j] = both[:, j] = both[i, i] = 0
        size[i], size[j] = size[i] + size[j], 0
        open_pairs[j] = open_pairs[:, j] = 0
        open_pairs[i] = open_pairs[:, i] = np.where(size + size[i] <= width, both[i], 0)
    return np.unique(area, return_inverse=True)[1]


def _routes(router, most: int):
    """rep, v to area, home (the part that the vector is stored in, -1: in another area), parts (of this area, to be searched), rep, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, w, b, area = router.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                top, used = _probed(_matrix(batch.column(1)), mean, w, b, most)
                rows, places = np.nonzero(used)
                parts = top[rows, places]
                order = np.lexsort((places, area[parts], rows))
                rows, places, parts = rows[order], places[order], parts[order]
                first = np.flatnonzero(np.r_[True, (np.diff(rows) != 0) | (np.diff(area[parts]) != 0)][: len(rows)])
                home = np.where(places[first] == 0, parts[first], -1)  # the most probable part comes first in its area
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(rows)].astype(np.int32)), pa.array(parts.astype(np.int32)))
                of = pa.array(rows[first])
                yield pa.RecordBatch.from_arrays([pa.array(area[parts[first]].astype(np.int32)), pa.array(home.astype(np.int32)), lists, batch.column(0).take(of), batch.column(1).take(of)], ["area", "home", "parts", "rep", "v"])

    return run


def _search(group: pa.Table) -> pa.Table:
    """The k nearest of a block for each of its searches, among the stored vectors of the parts that it asks for: query, cosines (times 10^9) and reps."""
    x, ids, home = _matrix(group["v"].combine_chunks()), group["rep"].to_numpy(), group["home"].to_numpy()
    small, lists = x.astype(np.float32), group["parts"].combine_chunks()
    asking, asked = pc.list_parent_indices(lists).to_numpy(), lists.flatten().to_numpy()
    found = []
    for part in np.unique(home[home >= 0]):
        stored, searches = np.flatnonzero(home == part), asking[asked == part]
        stored = stored[np.argsort(ids[stored])]
        k = min(K + 1, len(stored))
        for at in range(0, len(searches), _CHUNK):
            q = searches[at : at + _CHUNK]
            s = small[q] @ small[stored].T
            least = np.partition(s, len(stored) - k, axis=1)[:, len(stored) - k] if k < len(stored) else s.min(1)
            rows, cols = np.nonzero(s >= (least - 4e-6)[:, None])
            rows, cols = q[rows], stored[cols]
            other = ids[rows] != ids[cols]
            rows, cols = rows[other], cols[other]
            found.append(_nearest(rows, np.rint(np.einsum("ij,ij->i", x[rows], x[cols]) * 1e9).astype(np.int64), ids[cols]))
    rows, exact, reps = _nearest(*map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.r_[True, np.diff(rows) != 0][: len(rows)])
    offsets = pa.array(np.r_[first, len(rows)].astype(np.int32))
    return pa.table({"query": pa.array(ids[rows[first]]), "cosines": pa.ListArray.from_arrays(offsets, pa.array(exact.astype(np.int32))), "reps": pa.ListArray.from_arrays(offsets, pa.array(reps))})


def _nearest(rows: np.ndarray, exact: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first K of each row: larger cosines first, then smaller ids."""
    best = np.lexsort((reps, -exact, rows))
    rows, exact, reps = rows[best], exact[best], reps[best]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < K
    return rows[keep], exact[keep], reps[keep]


def nearest_vectors(vectors: DataFrame, id_column: str = "row_id", column: str = "normFeatures", part_size: int = PART_SIZE, point_block: int = POINT_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """row_id, neighbour, cosine (times 10^9, rounded) and place of the K nearest other records of every record."""
    spark = vectors.sparkSession
    space = Workspace(spark, "vectors")
    v = F.col("v")
    usable = (F.size(v) == DIMENSIONS) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("row_id"), F.col(column).cast("array<float>").alias("v")).where(F.col("row_id").isNotNull() & v.isNotNull() & usable)
    rows = rows.groupBy("row_id").agg(F.min("v").alias("v")).mapInArrow(_packed, "row_id long, v binary")
    rows = space.write(rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v")))
    order = Window.partitionBy("h1", "h2").orderBy("row_id")
    # a row_number filter keeps the first few of each class before the shuffle too
    members = rows.select("row_id", "h1", "h2").withColumn("place", F.row_number().over(order)).where(F.col("place") <= K + 1)
    classes = space.write(members.groupBy("h1", "h2").agg(F.min("row_id").alias("rep"), F.sort_array(F.collect_list("row_id")).alias("members")))
    # as many files as tasks that route them, so they need not be shuffled again for that
    reps = rows.select("row_id", "v").repartition(parallelism(spark), "row_id")
    reps = space.write(reps.join(classes.select("rep"), reps.row_id == F.col("rep"), "left_semi").select(F.col("row_id").alias("rep"), "v"))
    n = reps.count()
    parts = max(1, min(round(n / part_size), SAMPLE_BOUND // 16))
    wanted = min(SAMPLE_BOUND, parts * SAMPLE_PER_PART) if parts > 1 else 1
    picked = reps.select("v", F.xxhash64(F.lit(17), "rep").alias("order")).orderBy("order").limit(wanted).toArrow() if n else None
    fitted, areas = (np.zeros(DIMENSIONS, np.float32), np.zeros((DIMENSIONS, 1), np.float32), np.zeros(1, np.float32)), np.zeros(1, np.int64)
    if n:
        sample = _matrix(picked["v"].combine_chunks())
        fitted = fit_index(sample, parts)
        # areas of half a block of vectors, and some for each task
        areas = group_parts(sample, fitted, min(round(point_block * parts / n / 2), parts // (2 * parallelism(spark))))
    router = spark.sparkContext.broadcast((*fitted, areas))
    routed = space.write(reps.mapInArrow(_routes(router, MOST_PARTS), "area int, home int, parts array<int>, rep long, v binary"))
    space.drop(reps)
    # blocks of areas: a bounded table, one row for each area
    sizes = routed.groupBy("area").agg(F.count_if(F.col("home") >= 0).alias("points"), F.count("*").alias("queries")).collect()
    point_blocks = {r.area: math.ceil(r.points / point_block) for r in sizes if r.points > point_block}
    query_blocks = {r.area: math.ceil(r.queries / query_block) for r in sizes if r.queries > query_block}
    number = lambda d: F.coalesce(F.create_map(*[x for k, c in d.items() for x in (F.lit(k), F.lit(c))])[F.col("area")], F.lit(1)) if d else F.lit(1)
    pb, qb, h = number(point_blocks), number(query_blocks), F.xxhash64(F.lit(3), "rep")
    own_pb, own_qb, none = F.pmod(h, pb).cast("int"), F.pmod(h, qb).cast("int"), F.array().cast("array<int>")
    # a vector meets all blocks of searches and searches all blocks of vectors; where both lead to one block it is sent once
    points = routed.where("home >= 0").select("*", own_pb.alias("pb"), F.explode(F.sequence(F.lit(0), (qb - 1).cast("int"))).alias("qb")).withColumn("parts", F.when(F.col("qb") == own_qb, F.col("parts")).otherwise(none))
    queries = routed.select("*", F.explode(F.sequence(F.lit(0), (pb - 1).cast("int"))).alias("pb"), own_qb.alias("qb")).where((F.col("home") < 0) | (F.col("pb") != own_pb)).withColumn("home", F.lit(-1))
    found = points.unionByName(queries).groupBy("area", "pb", "qb").applyInArrow(_search, "query long, cosines array<int>, reps array<long>")
    pairs = found.select("query", F.arrays_zip((F.transform("cosines", lambda c: -c)).alias("far"), F.col("reps").alias("rep")).alias("found"))
    # at most MOST_PARTS lists (times the blocks of an area) of K
    near = pairs.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, K).alias("found")).select("query", F.explode("found").alias("x")).select("query", "x.far", F.col("x.rep").alias("rep"))
    near = space.write(near)
    space.drop(routed)
    others = near.join(classes.select("rep", "members"), "rep").select("query", "far", F.explode(F.slice("members", 1, K)).alias("row"))
    own = classes.select(F.col("rep").alias("query"), F.lit(-1_000_000_000).alias("far"), F.explode("members").alias("row"))
    lists = others.unionByName(own).groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "row"))), 1, K + 1).alias("list"))
    ranked = lists.join(classes.select(F.col("rep").alias("query"), "h1", "h2"), "query")
    each = rows.select("row_id", "h1", "h2").join(ranked, ["h1", "h2"]).select("row_id", F.slice(F.filter("list", lambda x: x["row"] != F.col("row_id")), 1, K).alias("list"))
    return each.select("row_id", F.posexplode("list").alias("place", "x")).select("row_id", F.col("x.row").alias("neighbour"), (-F.col("x.far")).alias("cosine"), (F.col("place") + 1).alias("place"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest_vectors(table(spark, sf_dir, "vectors"))
    return near.select(F.least("row_id", "neighbour").alias("row_id_1"), F.greatest("row_id", "neighbour").alias("row_id_2")).distinct()
