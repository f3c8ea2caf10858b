"""Subject areas of each document (problem 9): weighted terms, truncated singular value decomposition, refined seed centroids.

Words and pairs of words within a sentence are hashed into BUCKETS columns. A term weighs its inverse document frequency times how
much it tells subjects apart among the labelled documents (Kullback-Leibler distance of its subjects from the usual ones). A
randomised truncated SVD over all documents (power passes with OVERSAMPLED further directions, then a rotation to the leading ones)
gives DIMENSIONS latent directions; the directions in which documents of one subject
differ anyway are scaled down. Seeds are the mean directions of the labelled documents of a subject. They are refined iteratively:
every document clearly nearest to a centroid takes part in its next mean, half of which stays the seed. A document gets each subject whose centroid
has a cosine above the threshold that serves the labelled documents best, so it may get several or none.

Terms, weights, decomposition and refinement cover all documents; the seeds come from at most MOST_LABELLED labelled ones. Each pass
leaves one partial matrix of fixed size per core; they are summed by blocks in levels of FAN_IN, so no task adds up more than that. Labels are read whatever their case, blanks and separators;
those of no subject of the list are ignored, contradictory ones share a document. Labelled documents and null or blank texts get no
rows. Repeated rows come out once. Long texts are read whole. Without labels or documents the result is empty.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, is_blank, parallelism, table
from .titles import repair

BUCKETS, DIMENSIONS, BLOCK = 1 << 16, 96, 1024
#: Entries of sparse rows worked on at once, so that their products stay in a core's cache.
CACHED = 2000
#: Directions that the decomposition carries beyond those kept, and matrices that one task adds up.
OVERSAMPLED, FAN_IN = 16, 32
#: Documents with labels that the seeds, weights of terms and the threshold come from.
MOST_LABELLED = 20_000
#: Least documents of a term; what a term weighs that tells nothing apart; ridge of the scaling; passes of power iteration and refinement.
LEAST_DOCUMENTS, PLAIN_WEIGHT, RIDGE, POWER_PASSES, REFINEMENTS = 3, 0.2, 0.2, 2, 3
_SENTENCE = re.compile(r"[.!?;:\n]+ *")
_WORD = re.compile(r"[^\W\d_]{2,}")


class _Hasher:
    """Buckets of terms; the hashes of words met in a task are kept up to a number."""

    def __init__(self, most: int = 200_000):
        self.known: dict[str, int] = {}
        self.most = most

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        if len(known) > self.most:
            known.clear()
        flat: list[int] = []
        for sentence in _SENTENCE.split(repair(text)):
            for w in _WORD.findall(sentence):
                h = known.get(w)
                if h is None:
                    h = known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                flat.append(h)
            flat.append(-1)
        h = np.array(flat, np.int64)
        pairs = (h[:-1] >= 0) & (h[1:] >= 0)
        both = (h[:-1][pairs] * 1_000_003 + h[1:][pairs] * 7) >> 3
        return np.unique(np.concatenate([h[h >= 0], both]) % BUCKETS, return_counts=True)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, label, text to doc_id, label, buckets and counts as bytes."""
    hasher = _Hasher()
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            found = [hasher.counts(t) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([b.astype(np.int32).tobytes() for b, _ in found], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in found], pa.binary())], ["doc_id", "label", "buckets", "counts"])


class Rows:
    """Sparse rows of a batch: bucket, count and row of each entry, without empty rows."""

    def __init__(self, batch: pa.RecordBatch):
        buckets, counts = batch.column("buckets").to_pylist(), batch.column("counts").to_pylist()
        self.n = len(buckets)
        self.bucket = np.frombuffer(b"".join(buckets), np.int32)
        self.count = np.frombuffer(b"".join(counts), np.int32)
        self.row = np.repeat(np.arange(self.n), [len(b) // 4 for b in buckets])

    def weigh(self, weight: np.ndarray) -> None:
        value = np.sqrt(self.count).astype(np.float32) * weight[self.bucket]
        used = value > 0
        self.bucket, self.row, value = self.bucket[used], self.row[used], value[used]
        norm = np.sqrt(np.bincount(self.row, value * value, minlength=self.n))
        self.value = (value / norm[self.row]).astype(np.float32)

    def times(self, q: np.ndarray) -> np.ndarray:
        """The rows times q."""
        out = np.zeros((self.n, q.shape[1]), np.float32)
        for group, low, high, starts in _groups(self.row):
            x = q.take(self.bucket[low:high], axis=0)
            x *= self.value[low:high, None]
            out[group] = np.add.reduceat(x, starts, axis=0)
        return out

    def add_transposed(self, z: np.ndarray, into: np.ndarray) -> None:
        """Adds the transposed rows times z."""
        order = np.argsort(self.bucket, kind="stable")
        bucket, row, value = self.bucket[order], self.row[order], self.value[order]
        for group, low, high, starts in _groups(bucket):
            x = z.take(row[low:high], axis=0)
            x *= value[low:high, None]
            into[group] += np.add.reduceat(x, starts, axis=0)


def _groups(keys: np.ndarray) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
    """Runs of equal keys, about CACHED entries at a time: the keys, first and last entry, and where each run starts from there."""
    if not len(keys):
        return
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ends = np.r_[starts[1:], len(keys)]
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CACHED, side="right")))
        yield keys[starts[at:to]], int(starts[at]), int(ends[to - 1]), starts[at:to] - starts[at]
        at = to


def _summed(partial: DataFrame, rows: int, columns: int, tasks: int) -> np.ndarray:
    """The sum of the tasks' matrices (part int, x binary: blocks of float32 rows), added up in levels of FAN_IN; of fixed size, so it goes to the driver."""

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(0)
        for chunk in group["x"].chunks:
            for x in chunk:
                x = np.frombuffer(x.as_buffer(), np.float32).astype(np.float64)
                total = x if not len(total) else total + x
        return pa.table({"part": group["part"].slice(0, 1), "task": group["task"].slice(0, 1), "x": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    level = partial.withColumn("task", F.spark_partition_id())
    while True:
        level = level.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("part", "task").applyInArrow(add, "part int, task int, x binary")
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            break
    out = np.zeros((rows, columns), np.float32)
    for r in level.toLocalIterator():
        x = np.frombuffer(r.x, np.float32).reshape(-1, columns)
        out[r.part * BLOCK : r.part * BLOCK + len(x)] = x
    return out


def _blocks(matrix: np.ndarray) -> pa.RecordBatch:
    matrix = matrix.astype(np.float32)
    parts = [k for k in range(-(-len(matrix) // BLOCK)) if matrix[k * BLOCK : (k + 1) * BLOCK].any()]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([matrix[k * BLOCK : (k + 1) * BLOCK].tobytes() for k in parts], pa.binary())], ["part", "x"])


def _frequencies(subjects: int):
    """Documents of each bucket (column 0), and those of each subject among the labelled (columns 1 on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, 1 + subjects))
        for batch in batches:
            rows = Rows(batch)
            total[:, 0] += np.bincount(rows.bucket, minlength=BUCKETS)
            labels = batch.column("label").to_pylist()
            for k, label in enumerate(labels):
                if label:
                    mine = np.frombuffer(batch.column("buckets")[k].as_py(), np.int32)
                    for s in label:
                        total[mine, 1 + s] += 1 / len(label)
        yield _blocks(total)

    return run


def _power(shared):
    """A partial of A'(A q), with the column sums of A as the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, q = shared.value
        total = np.zeros((BUCKETS, q.shape[1] + 1), np.float32)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = Rows(batch.slice(at, 2000))
                rows.weigh(weight)
                z = rows.times(q)
                rows.add_transposed(np.c_[z, np.ones(len(z), np.float32)], total)
        yield _blocks(total)

    return run


def _embedded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, q = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows = Rows(part)
                rows.weigh(weight)
                x, some = rows.times(q), np.bincount(rows.row, minlength=rows.n) > 0
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([v.tobytes() if k else None for v, k in zip(x, some, strict=True)], pa.binary())], ["doc_id", "label", "x"])

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


def scaling(x: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The map that scales down what differs between documents of one subject; share: subjects of each row."""
    single = share.max(1) > 0.99
    if single.sum() < 2 * share.shape[1]:
        single = np.ones(len(x), bool)
    mine, of = x[single], share[single].argmax(1)
    means = np.stack([mine[of == s].mean(0) if (of == s).any() else np.zeros(x.shape[1]) for s in range(share.shape[1])])
    inner = mine - means[of]
    cov = inner.T @ inner / len(inner)
    cov += (RIDGE * np.trace(cov) / len(cov) + 1e-12) * np.eye(len(cov))
    w, u = np.linalg.eigh(cov)
    return u / np.sqrt(w)


def best_threshold(scores: np.ndarray, truth: np.ndarray) -> float:
    """The cosine above which the labels are met best by F1."""
    tries = np.linspace(0.02, 0.7, 69)
    f1 = [2 * ((scores > t) & truth).sum() / max(1, (scores > t).sum() + truth.sum()) for t in tries]
    return float(tries[int(np.argmax(f1))])


def _means(shared):
    """Sum of the unit vectors that are clearly nearest to each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, scale, centres, clear = shared.value
        total = np.zeros(centres.shape, np.float64)
        for batch in batches:
            e = _unit((_vectors(batch.column("x")) - mean) @ scale)
            s = e @ centres.T
            near = (s == s.max(1, keepdims=True)) & (s > clear)
            total += near.T.astype(np.float64) @ e
        yield _blocks(total)

    return run


def _assigned(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, scale, centres, threshold = shared.value
        for batch in batches:
            row, subject = np.nonzero(_unit((_vectors(batch.column("x")) - mean) @ scale) @ centres.T > threshold)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array([names[s] for s in subject], pa.string())], ["doc_id", "subject"])

    return run


def assign_subjects(documents: DataFrame, subject_list: DataFrame, subject_labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """doc_id and subject of each unlabelled document with text."""
    spark = documents.sparkSession
    context, space = spark.sparkContext, Workspace(spark, "subjects")
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = sorted(r.subject for r in subject_list.select("subject").where("subject is not null").distinct().collect())  # the list of areas is the stated, short scheme
    nothing = spark.createDataFrame([], f"doc_id {kind}, subject string")
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+", "_")
    codes = F.create_map(*[x for k, s in enumerate(names) for x in (F.lit(re.sub(r"[\W_]+", "_", s.strip().lower())), F.lit(k))]) if names else None
    if not names:
        return nothing
    labels = subject_labels.where("doc_id is not null").select("doc_id", codes[plain(F.col("subject"))].alias("code"))
    labels = labels.groupBy("doc_id").agg(F.sort_array(F.collect_set("code")).alias("label"))  # at most as many as there are subjects
    labels = space.write(labels)
    known = labels.where("size(label) > 0").count()
    if not known:
        return nothing
    every = -(-known // most_labelled)
    labels = labels.withColumn("label", F.when(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(every)) == 0, F.col("label")).otherwise(F.array().cast("array<int>")))
    texts = documents.select("doc_id", "text").where(~is_blank(F.col("text")) & F.col("doc_id").isNotNull()).join(labels, "doc_id", "left").select("doc_id", "label", "text")
    tokens = space.write(texts.repartition(parallelism(spark)).mapInArrow(_tokens, f"doc_id {kind}, label array<int>, buckets binary, counts binary"))
    tasks = max(2, context.defaultParallelism)
    cores = tokens.coalesce(tasks)

    n = tokens.count()
    counts = _summed(cores.mapInArrow(_frequencies(len(names)), "part int, x binary"), BUCKETS, 1 + len(names), tasks).astype(np.float64)
    df, by_subject = counts[:, 0], counts[:, 1:]
    usual = (by_subject.sum(0) + 1) / (by_subject.sum() + len(names))
    p = (by_subject + 3 * usual) / (by_subject.sum(1, keepdims=True) + 3)
    weight = np.log((n + 1) / (df + 1)) * (PLAIN_WEIGHT + (p * np.log(p / usual)).sum(1))
    weight = np.where(df >= LEAST_DOCUMENTS, np.maximum(weight, 0), 0).astype(np.float32)
    del counts, by_subject, p

    width = DIMENSIONS + OVERSAMPLED
    q = np.linalg.qr(np.random.default_rng(19).standard_normal((BUCKETS, width)))[0].astype(np.float32)
    for turn in range(POWER_PASSES):
        shared = context.broadcast((weight, q))
        y = _summed(cores.mapInArrow(_power(shared), "part int, x binary"), BUCKETS, width + 1, tasks)
        shared.unpersist()
        if turn + 1 < POWER_PASSES:
            q = np.linalg.qr(y[:, :-1])[0].astype(np.float32)
    # Rayleigh-Ritz in the span of A'A q: the directions of greatest share there, the oversampled ones dropped
    small = q.T.astype(np.float64) @ y[:, :-1]
    w, u = np.linalg.eigh((small + small.T) / 2)
    root = u[:, ::-1] / np.sqrt(np.maximum(w[::-1], 1e-9 * max(w[-1], 1e-30)))
    # Nystrom: y (q' y)^(-1/2) has the singular vectors of A'A restricted to the span
    left, _, _ = np.linalg.svd(y[:, :-1].astype(np.float64) @ root, full_matrices=False)
    q = left[:, :DIMENSIONS].astype(np.float32)
    mean = (y[:, -1] @ q) / max(1, n)
    shared = context.broadcast((weight, q))
    vectors = space.write(tokens.mapInArrow(_embedded(shared), f"doc_id {kind}, label array<int>, x binary").where("x is not null"))

    # bounded: at most most_labelled documents, give or take the evenness of a hash
    seeds = vectors.where("size(label) > 0").select("label", "x").toArrow()
    if not seeds.num_rows:
        return nothing
    x = _vectors(seeds["x"].combine_chunks()).astype(np.float64) - mean
    share = np.zeros((len(x), len(names)))
    for k, label in enumerate(seeds["label"].to_pylist()):
        for s in label:
            share[k, s] += 1 / len(label)
    truth = share > 0
    scale = scaling(x, share)
    e = _unit(x @ scale)
    seed = _unit(np.stack([e[truth[:, s]].mean(0) if truth[:, s].any() else np.zeros(e.shape[1]) for s in range(len(names))]))
    centres = seed
    for _ in range(REFINEMENTS):
        clear = best_threshold(e @ centres.T, truth) + 0.1
        shared = context.broadcast((mean, scale, centres, clear))
        total = _summed(vectors.coalesce(tasks).mapInArrow(_means(shared), "part int, x binary"), len(names), DIMENSIONS, tasks)
        centres = _unit(0.5 * seed + 0.5 * _unit(total.astype(np.float64)))
    shared = context.broadcast((mean, scale, centres, best_threshold(e @ centres.T, truth)))
    return vectors.where("label is null").mapInArrow(_assigned(shared, names), f"doc_id {kind}, subject string").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_subjects(*(table(spark, sf_dir, t) for t in ("documents", "subject_list", "subject_labels")))
