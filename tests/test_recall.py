import numpy as np

from kinsift.operators import neighbors, partitioning
from kinsift.operators.blocking import with_blocking_key
from kinsift.operators.embedding import hashed_embedder, with_features
from kinsift.operators.workspace import Workspace
from kinsift.plans import catalog
from kinsift.sources.records import synthetic_records


def test_registered_approx_knn_recall(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((8, 64))[rng.integers(0, 8, 600)] * 0.6 + rng.standard_normal((600, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    spark.createDataFrame([(k, v.tolist(), "x") for k, v in enumerate(x)], "vec_id long, embedding array<float>, label string").write.parquet(str(tmp_path / "embeddings.parquet"))
    pairs = lambda df: {(r.src_id, r.dst_id) for r in df.select("src_id", "dst_id").collect()}
    exact = pairs(catalog._knn(spark, str(tmp_path)))
    found = pairs(catalog.queries()["approx_knn"](spark, str(tmp_path)))
    assert len(exact) == 12_000 and len(found & exact) / len(exact) >= 0.9


def test_registered_centroid_recall(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((12, 64))[rng.integers(0, 12, 900)] * 0.6 + rng.standard_normal((900, 64))
    spark.createDataFrame([(k, v.tolist(), "x") for k, v in enumerate(x)], "vec_id long, embedding array<float>, label string").write.parquet(str(tmp_path / "embeddings.parquet"))
    pairs = lambda df: {(r.src_id, r.dst_id) for r in df.select("src_id", "dst_id").collect()}
    exact = pairs(catalog._knn(spark, str(tmp_path)))
    found = pairs(catalog.queries()["centroid_knn"](spark, str(tmp_path)))
    assert len(found & exact) / len(exact) >= 0.9


def test_registered_pipeline_index_recall_in_many_cells(spark):
    config = catalog.WIDE_CONFIG
    rows = with_features(with_blocking_key(synthetic_records(spark, 1200, 400), list(config.features), config.num_blocking_cols), hashed_embedder(config.buckets))
    vectors = Workspace(spark, "recall").write(rows.select("row_id", "normFeatures"))
    assert config.use_partitions and config.index == "centroids"
    pairs = lambda df: {(r.src_id, r.dst_id) for r in df.select("src_id", "dst_id").collect()}
    exact = pairs(neighbors.exact_knn(vectors, config.k))
    found = pairs(neighbors.centroid_knn(vectors, config.k, config.least_recall, cell_rows=40))
    assert len(found & exact) / len(exact) >= 0.9
    blocked = pairs(neighbors.centroid_knn(vectors, config.k, config.least_recall, cell_rows=40, point_block=30, query_block=70))
    assert blocked == found


def test_centroids_of_few_rows(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (None, [1.0, 1.0])], "row_id long, normFeatures array<float>")
    assert sorted((r.src_id, r.dst_id) for r in neighbors.centroid_knn(v, 3).collect()) == [(1, 2), (2, 1)]
    assert neighbors.centroid_knn(v.limit(0), 3).count() == 0


def test_depth_and_sample(spark):
    assert [partitioning.depth_for(n) for n in (0, 4096, 5000, 4096 * 64, 10**9)] == [0, 0, 1, 6, 18]
    v = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(2000)] + [(9999, None)], "row_id long, normFeatures array<float>")
    x = partitioning.sampled(v, "normFeatures", "row_id", 300)
    # drawn over all rows, not the first ones
    assert 200 < len(x) <= 300 and x[:, 0].max() > 1500
    head = partitioning.learn_tree(v, sample_size=100, max_tree_depth=2, min_leaf_size=10, head=True)
    assert partitioning.leaf_count(head) == 4
    assert partitioning.leaf_count(partitioning.learn_tree(v, max_tree_depth=None, min_leaf_size=10)) == 1


def test_registered_tree_recall_at_64_leaves(spark):
    config = catalog.WIDE_CONFIG
    rows = with_features(with_blocking_key(synthetic_records(spark, 1200, 400), list(config.features), config.num_blocking_cols), hashed_embedder(config.buckets))
    vectors = Workspace(spark, "recall").write(rows.select("row_id", "normFeatures"))
    # larger tables get all 64 leaves of the configured depth; here small leaves give them
    tree = partitioning.learn_tree(vectors, max_tree_depth=config.max_tree_depth, min_leaf_size=4)
    assert partitioning.leaf_count(tree) == 64
    pairs = lambda df: {(r.src_id, r.dst_id) for r in df.select("src_id", "dst_id").collect()}
    exact = pairs(neighbors.exact_knn(vectors, config.k, metric=config.metric))
    found = pairs(neighbors.approx_knn(vectors, tree, config.k, config.spill_alpha, metric=config.metric))
    assert len(found & exact) / len(exact) >= 0.9
