import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinsift.config import PipelineConfig
from kinsift.operators import clusters, neighbors, pairs, partitioning, reports, similarity
from kinsift.plans.cli import main
from kinsift.plans.pipeline import run
from kinsift.sources.records import synthetic_records
from kinsift.streaming.scoring import score_arrivals


def vectors(spark, n=60, d=4, seed=1, extra=()):
    rng = np.random.default_rng(seed)
    rows = [(k, [float(x) for x in rng.standard_normal(d)]) for k in range(n)] + list(extra)
    return spark.createDataFrame(rows, "row_id long, normFeatures array<float>")


@pytest.mark.parametrize("metric", ["cosine", "sqeuclidean"])
def test_blocks_equal_the_expression(spark, metric):
    v = vectors(spark, extra=[(100, [0.0] * 4), (101, None), (102, [1.0, 1.0, 1.0, 1.0]), (103, [1.0, 1.0, 1.0, 1.0])])
    key = lambda df: sorted((r.src_id, r.rank, r.dst_id, round(r.distance, 6)) for r in df.collect())
    whole = key(neighbors.exact_knn(v, 5, metric=metric))
    assert whole == key(neighbors.exact_knn_expression(v, 5, metric=metric))
    assert whole == key(neighbors.exact_knn(v, 5, metric=metric, point_block=13, query_block=17))
    assert all(s != d for s, _, d, _ in whole)


def test_few_rows_and_duplicates(spark):
    v = vectors(spark, 0, extra=[(1, [1.0, 0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0, 0.0])])
    assert neighbors.exact_knn(v, 5).groupBy("src_id").count().collect()[0]["count"] == 2
    kept = {(r.src_id, r.dst_id) for r in neighbors.exact_knn(v, 5, drop_zero_distance=True).collect()}
    assert (1, 2) not in kept and (1, 3) in kept
    assert neighbors.exact_knn(v.limit(0), 5).count() == 0
    assert neighbors.exact_knn(v.limit(1), 5).count() == 0
    model = neighbors.NearestNeighbors(2).fit(v).transform(v)
    assert {r.row_id: len(r.neighbors) for r in model.collect()} == {1: 2, 2: 2, 3: 2}


def test_tree_partitions(spark):
    v = vectors(spark, 200, extra=[(999, None)])
    tree = partitioning.learn_tree(v, max_tree_depth=3, min_leaf_size=20)
    assert partitioning.leaf_count(tree) == 8
    by_expression = {r.row_id: r.partition_id for r in partitioning.assign_partition(v, tree).collect()}
    narrow = {r.row_id: r.queryPartitions for r in partitioning.spill_partitions(v, tree, 0.05).collect()}
    wide = {r.row_id: r.queryPartitions for r in partitioning.spill_partitions(v, tree, 0.3).collect()}
    assert by_expression.pop(999) == -1 and narrow[999] == []
    for i, p in by_expression.items():
        assert p in narrow[i] and set(narrow[i]) <= set(wide[i])
    partitioning.EXPRESSION_LEAVES = 0
    try:
        assert {r.row_id: r.partition_id for r in partitioning.assign_partition(v, tree).where("row_id != 999").collect()} == by_expression
        assert {r.row_id: r.queryPartitions for r in partitioning.spill_partitions(v, tree, 0.05).collect()} == narrow
    finally:
        partitioning.EXPRESSION_LEAVES = 8
    assert partitioning.partition_counts(partitioning.assign_partition(v, tree)).agg(F.sum("records")).first()[0] == 201
    exact = {(r.src_id, r.dst_id) for r in neighbors.exact_knn(v, 5).collect()}
    near = {(r.src_id, r.dst_id) for r in neighbors.approx_knn(v, tree, 5, 0.3).collect()}
    assert len(near & exact) / len(exact) > 0.9
    assert near == {(r.src_id, r.dst_id) for r in neighbors.approx_knn(v, tree, 5, 0.3, point_block=11, query_block=9).collect()}


def test_unsplittable_sample_is_one_leaf(spark):
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(30)], "row_id long, normFeatures array<float>")
    tree = partitioning.learn_tree(same, min_leaf_size=2)
    assert partitioning.leaf_count(tree) == 1
    assert partitioning.leaf_count(partitioning.learn_tree(same.limit(0))) == 1


def test_pairs(spark):
    n = spark.createDataFrame([(1, [(2, 0.1), (3, None)]), (2, None)], "row_id long, neighbors array<struct<neighbor:long,distance:double>>")
    taken = pairs.explode_neighbors(n)
    assert sorted((r.src_id, r.dst_id, r.distance) for r in taken.collect()) == [(1, 2, 0.1), (1, 3, 0.0)]
    records = spark.createDataFrame([(1, "a", "k"), (2, "b", "k")], "row_id long, t string, blockingKey string")
    wide = pairs.extract_pairs(n, records)
    assert wide.columns == ["src_id", "dst_id", "distance", "t_l", "t_r"]
    assert {(r.dst_id, r.t_r) for r in wide.collect()} == {(2, "b"), (3, None)}
    assert pairs.comparison_pairs(taken.drop("pos"), records, ["t"]).columns[-2:] == ["t_l", "t_r"]
    assert pairs.filter_by_distance(taken, 0.05).count() == 1 and pairs.filter_by_distance(taken.drop("distance"), 0.05).count() == 2
    assert pairs.clustering_distance(0.9) == 0.3 and pairs.clustering_distance(None) == 0.3 and pairs.clustering_distance(0.2) == pytest.approx(0.14)


def test_scores(spark):
    p = spark.createDataFrame([(1, 2, "a", "a", "x", "y"), (1, 3, "a", "b", "x", "x")], "src_id long, dst_id long, t_l string, t_r string, u_l string, u_r string")
    scored = similarity.with_similarities(p, ["t", "u", "none"])
    assert [(r.t_sim, r.u_sim, r.none_sim) for r in scored.orderBy("dst_id").collect()] == [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0)]
    assert similarity.filter_by_thresholds(scored, ["t"]).count() == 1
    assert similarity.filter_by_thresholds(scored, ["missing"]).count() == 2
    rates = {r.attribute: (r.passed, r.total, r.percent) for r in similarity.pass_rates(scored, ["t", "u"]).collect()}
    assert rates == {"t": (1, 2, 50.0), "u": (1, 2, 50.0), "overall": (0, 2, 0.0)}
    assert similarity.pass_rates(scored.limit(0), ["t"]).first().percent is None
    assert [r.overall_similarity for r in similarity.with_overall(scored, ["t", "u"], {"t": 3}).orderBy("dst_id").collect()] == [1.0, 0.0]
    assert similarity.with_overall(scored, ["t"], {}).first().overall_similarity == 0.0
    stats = {r.attribute: r for r in similarity.similarity_stats(scored, ["t"]).collect()}["t"]
    assert (stats["mean"], stats["median"], stats["count"]) == (0.5, 0.5, 2)
    many = spark.range(1001).selectExpr("id / 1000 AS t_sim")
    assert abs(similarity.similarity_stats(many, ["t"], 1000).first()["median"] - similarity.similarity_stats(many, ["t"]).first()["median"]) <= 0.002
    empty = similarity.similarity_stats(scored.limit(0), ["t"]).first()
    assert (empty["mean"], empty["std"], empty["count"]) == (0.0, 0.0, 0)
    assert similarity.update_thresholds({"a": 0.5}, {"b": 1}) == {"a": 0.5, "b": 1} and similarity.threshold_of({}, "x") == 0.7
    placed = scored.withColumn("pos", F.when(F.col("dst_id") == 2, 0).otherwise(7))
    assert [r.dst_id for r in similarity.filter_by_thresholds_legacy(placed, placed, []).collect()] == [2]


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 340)] + [(5, 5), (None, 3), (7, None), (2, 1), (1, 2)]
    df = spark.createDataFrame(edges, "src_id long, dst_id long")
    for local_edges in (clusters.LOCAL_EDGES, 0):
        assert {r.node: r.component for r in clusters.connected_components(df, local_edges).collect()} == brute_components(edges)
    assert clusters.connected_components(df.limit(0)).count() == 0


def test_labels_follow_the_smallest_source(spark):
    rows = spark.createDataFrame([(k,) for k in range(8)], "row_id long")
    edges = spark.createDataFrame([(6, 0), (1, 2), (2, 3)], "src_id long, dst_id long")
    got = {r.row_id: r.cluster_id for r in clusters.label_clusters(rows, edges).collect()}
    # the component of 1 comes first: its smallest source is 1, that of 0 and 6 is 6
    assert got == {1: 0, 2: 0, 3: 0, 0: 1, 6: 1, 4: 2, 5: 3, 7: 4}
    dissolved = {r.row_id: r.cluster_id for r in clusters.label_clusters(rows, edges, 3).collect()}
    assert dissolved == {1: 0, 2: 0, 3: 0, 0: 1, 4: 2, 5: 3, 6: 4, 7: 5}
    assert {r.row_id: r.cluster_id for r in clusters.label_clusters(rows, edges.limit(0)).collect()} == {k: k for k in range(8)}


def test_reports(spark):
    labelled = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 2)], "row_id long, cluster_id long")
    assert tuple(reports.cluster_summary(labelled).first()) == (6, 3, 2, 5, 3)
    assert tuple(reports.cluster_summary(labelled.limit(0)).first()) == (0, 0, 0, 0, 0)
    assert sum(r["count"] for r in reports.cluster_size_histogram(labelled).collect()) == 2
    assert reports.top_clusters(labelled, 1).count() == 3
    flat = spark.createDataFrame([(1.0,), (1.0,)], "distance double")
    assert [(r.bin, r["count"]) for r in reports.distance_histogram(flat).collect()] == [(1, 2)]
    assert reports.distance_histogram(flat.limit(0)).count() == 0
    assert tuple(reports.compare_methods(labelled, labelled).first()) == (2, 2, 0)


def test_pipeline(spark, tmp_path, capsys):
    made = synthetic_records(spark, 40, 14).drop("row_id")
    config = PipelineConfig(("title", "authors", "venue", "year"), 4, 5, max_distance=0.6, thresholds={"title": 0.6, "authors": 0.4, "venue": 0.6, "year": 0.9})
    result = run(made, config, row_order=("id",))
    s = result.summary().first()
    assert s.records == 40 and 1 < s.multi_clusters and s.largest < 15
    off = run(made, PipelineConfig(("title", "authors"), use_levenshtein=False, max_distance=0.4), row_order=("id",))
    assert off.summary().first().records == 40
    legacy = run(made, PipelineConfig(("title", "authors"), max_distance=0.6, legacy_alignment=True), row_order=("id",))
    assert legacy.pairs.count() <= legacy.scored.count()
    one = run(made.limit(1), config, row_order=("id",))
    assert one.summary().first().clusters == 1 and one.pairs.count() == 0
    assert main(["--data", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--create-sample"]) == 0
    assert "20 records" in capsys.readouterr().out


def test_arrivals_in_a_stream(spark, tmp_path):
    reference = spark.createDataFrame([(1, "x", "Deep nets"), (2, "y", "Deep nets")], "row_id long, b string, t string")
    spark.createDataFrame([(9, "x", "Deep net"), (8, None, "Deep nets")], "row_id long, b string, t string").write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(reference.schema).parquet(str(tmp_path / "in"))
    query = score_arrivals(arriving, reference, ["b"], ["t"]).writeStream.format("memory").queryName("scored").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.src_id, r.dst_id) for r in spark.table("scored").collect()] == [(9, 1)]
