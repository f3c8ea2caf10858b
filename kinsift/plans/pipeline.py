"""The whole run: blocking keys, vectors, neighbours, pairs, scores, clusters."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame

from kinsift.config import PipelineConfig
from kinsift.operators.blocking import alias, resolve_attributes, with_blocking_key
from kinsift.operators.clusters import label_clusters
from kinsift.operators.embedding import Embedder, hashed_embedder, with_features
from kinsift.operators.neighbors import approx_knn, centroid_knn, exact_knn, nest_neighbors
from kinsift.operators.pairs import clustering_distance, enrich_pairs, filter_by_distance
from kinsift.operators.partitioning import assign_partition, learn_tree
from kinsift.operators.reports import cluster_summary
from kinsift.operators.similarity import filter_by_thresholds, filter_by_thresholds_legacy, pass_rates, similarity_stats, with_positions, with_similarities
from kinsift.operators.workspace import Workspace
from kinsift.sources.records import assign_row_id, detect_features


@dataclass
class Result:
    """Tables of a run. pairs are those that clusters are made of; scored are all within max_distance."""

    records: DataFrame
    vectors: DataFrame
    neighbors: DataFrame
    scored: DataFrame
    pairs: DataFrame
    clusters: DataFrame
    attributes: list[str]
    seconds: float = 0.0

    def summary(self) -> DataFrame:
        return cluster_summary(self.clusters)

    def statistics(self) -> DataFrame:
        return similarity_stats(self.scored, self.attributes)

    def rates(self, thresholds: dict[str, float] | None = None) -> DataFrame:
        return pass_rates(self.scored, self.attributes, thresholds)


def run(df: DataFrame, config: PipelineConfig | None = None, embedder: Embedder | None = None, row_order: tuple[str, ...] = ()) -> Result:
    """Groups the records of df. Records keep their row_id if they have one and no order is given; else they are numbered. Empty and one-row tables give no pairs and single clusters."""
    config = config or PipelineConfig()
    began = time.time()
    space = Workspace(df.sparkSession, "pipeline")
    features = list(config.features or detect_features(df))
    records = df if "row_id" in df.columns and not row_order else assign_row_id(df, *row_order)
    keyed = with_blocking_key(records, features, config.num_blocking_cols)
    vectors = space.write(with_features(keyed, embedder or hashed_embedder(config.buckets)))
    if config.use_partitions and config.index not in ("tree", "centroids"):
        raise ValueError(f"no such index: {config.index}")
    if config.use_partitions and config.index == "centroids":
        ranked = centroid_knn(vectors, config.k, config.least_recall, metric=config.metric)
    elif config.use_partitions:
        tree = learn_tree(vectors, sample_size=config.sample_size, max_tree_depth=config.max_tree_depth, min_leaf_size=config.min_leaf_size)
        vectors = space.write(assign_partition(vectors, tree))
        ranked = approx_knn(vectors, tree, config.k, config.spill_alpha, metric=config.metric)
    else:
        ranked = exact_knn(vectors, config.k, metric=config.metric)
    ranked = space.write(ranked)
    attributes = resolve_attributes(vectors.drop("partition_id"), [alias(f) for f in features])
    thresholds = {**{a: config.default_threshold for a in attributes}, **{alias(k): v for k, v in config.thresholds.items()}}
    near = filter_by_distance(with_positions(ranked) if config.legacy_alignment else ranked, config.max_distance)
    enriched = enrich_pairs(near, vectors, attributes)
    if config.use_levenshtein:
        scored = space.write(with_similarities(enriched, attributes, config.missing))
        if config.legacy_alignment:
            scored = space.write(scored.join(near.select("src_id", "dst_id", "pos"), ["src_id", "dst_id"]))
            pairs = filter_by_thresholds_legacy(near, scored, attributes, thresholds)
        else:
            pairs = filter_by_thresholds(scored, attributes, thresholds)
    else:
        scored = space.write(enriched)
        pairs = filter_by_distance(scored, clustering_distance(config.max_distance))
    pairs = space.write(pairs)
    clusters = space.write(label_clusters(records, pairs.select("src_id", "dst_id"), config.min_cluster_size))
    return Result(records, vectors, nest_neighbors(ranked), scored, pairs, clusters, attributes, time.time() - began)
