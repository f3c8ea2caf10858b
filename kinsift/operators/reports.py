"""Summaries of pairs and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "cluster_id")


def cluster_summary(labelled: DataFrame) -> DataFrame:
    """records, clusters, multi_clusters (more than one record), multi_records (within those), largest; as one row."""
    sizes = labelled.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    many = F.col("size") > 1
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return sizes.agg(total("size").alias("records"), F.count(F.lit(1)).alias("clusters"), F.count_if(many).alias("multi_clusters"), total(F.when(many, F.col("size"))).alias("multi_records"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"))


def distinct_count(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias(name))


def neighbor_count(neighbors: DataFrame, column: str = "neighbors") -> DataFrame:
    return neighbors.agg(F.coalesce(F.sum(F.size(column)), F.lit(0)).cast("long").alias("pairs"))


def mean_distance(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg("distance").alias("mean_distance"))


def histogram(df: DataFrame, column: str, bins: int | None = None, most_bins: int | None = None) -> DataFrame:
    """bin (1..n), low, high, count over equal widths from the least to the greatest value, which falls into the last bin; empty bins are left out. most_bins: as many bins as rows, at most so many."""
    c = F.col(column).cast("double")
    limits = df.where(c.isNotNull()).agg(F.min(c).alias("least"), F.max(c).alias("most"), F.count(F.lit(1)).alias("rows"))
    limits = limits.withColumn("bins", F.lit(bins).cast("long") if bins else F.least(F.lit(most_bins or 20).cast("long"), F.col("rows")))
    width = (F.col("most") - F.col("least")) / F.col("bins")
    place = F.when(F.col("most") == F.col("least"), F.lit(1)).otherwise(F.least(F.floor(F.try_divide(c - F.col("least"), width)) + 1, F.col("bins"))).cast("long")
    counted = df.where(c.isNotNull()).crossJoin(F.broadcast(limits)).select(place.alias("bin"), "least", width.alias("width")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"), F.first("least").alias("least"), F.first("width").alias("width"))
    return counted.select("bin", (F.col("least") + (F.col("bin") - 1) * F.col("width")).alias("low"), (F.col("least") + F.col("bin") * F.col("width")).alias("high"), "count").orderBy("bin")


def cluster_size_histogram(labelled: DataFrame, most_bins: int = 20) -> DataFrame:
    """Sizes of the clusters with more than one record, in at most so many bins."""
    return histogram(cluster_sizes(labelled).where("size > 1"), "size", most_bins=most_bins)


def distance_histogram(pairs: DataFrame, bins: int = 30) -> DataFrame:
    return histogram(pairs, "distance", bins=bins)


def top_clusters(labelled: DataFrame, limit: int = 10) -> DataFrame:
    """Records of the largest clusters of more than one record (ties by the smaller cluster_id), with size, without row_id."""
    top = cluster_sizes(labelled).where("size > 1").limit(limit)
    return labelled.join(F.broadcast(top), "cluster_id").drop("row_id")


def head(df: DataFrame, order: str, rows: int = 10) -> DataFrame:
    return df.orderBy(order).limit(rows)


def column_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, distinct values, least and greatest value as text."""
    each = [F.struct(F.lit(c).alias("column"), F.count_distinct(c).alias("distinct_values"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest")) for c in columns]
    return df.agg(F.array(*each).alias("all")).select(F.explode("all").alias("x")).select("x.*")


def compare_methods(with_similarity: DataFrame, without: DataFrame) -> DataFrame:
    """Multi-record clusters of two labelled results, and how many the first has less."""
    count = lambda df, name: cluster_summary(df).select(F.col("multi_clusters").alias(name))
    both = count(with_similarity, "multi_with").crossJoin(count(without, "multi_without"))
    return both.withColumn("fewer", F.col("multi_without") - F.col("multi_with"))
