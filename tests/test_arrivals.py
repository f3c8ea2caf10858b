from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinsift.functions.columns import blocking_key
from kinsift.operators.similarity import filter_by_thresholds, with_similarities
from kinsift.streaming import scoring

ODD = [
    (1, "x", 1, "Deep nets", 3, -0.0), (1, "x", 1, "Deep nets", 3, -0.0), (2, "x", 1, "Deep nets", 3, 0.0), (None, "x", 1, "Deep nets", 3, 0.0), (None, "x", 1, "deep net ", 3, 1.5), (3, "x", 1, " deep net", 4, 1.5),
    (4, "x", 1, None, None, None), (5, "x", 1, "nan", None, float("nan")), (6, "x", 1, "", 3, 2.0), (7, "x", 1, " ", 3, 2.0), (8, "x", None, "Deep nets", 3, 2.0), (9, None, 1, "Deep nets", 3, 2.0),
    (10, "y", 1, "Größe İ", 3, 2.0), (11, "y", 1, "größe i", 33, 2.0), (12, "y", 1, "Deep nets", 3, 2.0),
]
KIND = "k long, b string, s int, t string, n int, f double"


def one_by_one(arrivals, reference, block_by, attributes, thresholds, id_column):
    """Every pair of a block scored by itself."""
    side = lambda df, key, suffix: df.dropna(subset=block_by).select(F.col(id_column).alias(key), blocking_key([F.col(b) for b in block_by]).alias("_block"), *[F.col(a).alias(f"{a}_{suffix}") for a in attributes])
    pairs = side(arrivals, "src_id", "l").join(side(reference, "dst_id", "r"), "_block").drop("_block")
    return filter_by_thresholds(with_similarities(pairs, attributes), attributes, thresholds)


def rows(df):
    return Counter(map(repr, df.collect()))


@pytest.mark.parametrize("attributes", [["t"], ["t", "n"], ["t", "f"]])
@pytest.mark.parametrize("most", [1, 3, 4096])
def test_all_pairs_of_odd_records(spark, monkeypatch, attributes, most):
    monkeypatch.setattr(scoring, "MOST_IDS", most)
    left, right = spark.createDataFrame([*ODD, *ODD[:5] * 2], KIND), spark.createDataFrame(ODD, KIND)
    args = (left, right, ["b", "s"], attributes, dict.fromkeys(attributes, 0.0) | {"t": 0.4}, "k")
    found = scoring.score_arrivals(*args)
    assert found.columns == one_by_one(*args).columns
    assert found.where("src_id IS NULL AND dst_id IS NULL").count() >= 4
    assert rows(found) == rows(one_by_one(*args))


def test_equal_records_are_scored_once(spark):
    """As many rows leave the join as there are pairs of different records, not of records."""
    records = spark.range(300).select(F.col("id").alias("k"), F.lit("x").alias("b"), F.when(F.col("id") % 3 == 0, "Deep nets").otherwise("Deep net").alias("t"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan's parts are hidden in its stages
    try:
        found = scoring.score_arrivals(records, records, ["b"], ["t"], {"t": 0.5}, "k")
        plan = found._jdf.queryExecution().executedPlan()
        assert len(found.collect()) == 300 * 300
        joined, todo = [], [plan]
        while todo:
            node = todo.pop()
            if "Join" in node.nodeName():
                joined.append(node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(k) for k in range(node.children().size())]
        assert joined == [4]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
