"""Edit similarity of attributes: scores, thresholds, weights and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsift.functions.columns import comparable, quoted, similarity_of

DEFAULT_THRESHOLD = 0.7


def with_similarities(pairs: DataFrame, attributes: list[str], missing: str = "nan") -> DataFrame:
    """<a>_sim of each attribute; 0 where the pair has no such columns."""
    has = [a for a in attributes if f"{a}_l" in pairs.columns and f"{a}_r" in pairs.columns]
    # texts are prepared in a projection of their own, which the optimiser keeps apart, so each is trimmed once
    prepared = pairs.select("*", *[comparable(quoted(f"{a}_{s}"), missing).alias(f"__{a}_{s}") for a in has for s in ("l", "r")])
    scores = [(similarity_of(quoted(f"__{a}_l"), quoted(f"__{a}_r")) if a in has else F.lit(0.0)).alias(f"{a}_sim") for a in attributes]
    return prepared.select(*map(quoted, pairs.columns), *scores)


def threshold_of(thresholds: dict[str, float], attribute: str) -> float:
    return thresholds.get(attribute, DEFAULT_THRESHOLD)


def update_thresholds(thresholds: dict[str, float], changes: dict[str, float]) -> dict[str, float]:
    return {**thresholds, **changes}


def _passes(df: DataFrame, attributes: list[str], thresholds: dict[str, float]) -> dict[str, Column]:
    return {a: quoted(f"{a}_sim") >= threshold_of(thresholds, a) for a in attributes if f"{a}_sim" in df.columns}


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def filter_by_thresholds(scored: DataFrame, attributes: list[str], thresholds: dict[str, float] | None = None) -> DataFrame:
    """Pairs all of whose attributes reach their thresholds; attributes without a score don't count."""
    return scored.where(_all(list(_passes(scored, attributes, thresholds or {}).values())))


def filter_by_thresholds_legacy(before: DataFrame, scored: DataFrame, attributes: list[str], thresholds: dict[str, float] | None = None) -> DataFrame:
    """As filter_by_thresholds, but a pair whose position before the distance filter (by src_id and rank) is not below the number of pairs after it is dropped. before and scored have pos."""
    kept = scored.agg(F.count(F.lit(1)).alias("_kept"))
    return filter_by_thresholds(scored, attributes, thresholds).join(F.broadcast(kept), F.col("pos") < F.col("_kept")).drop("_kept")


def pass_rates(scored: DataFrame, attributes: list[str], thresholds: dict[str, float] | None = None) -> DataFrame:
    """attribute ('overall' for all), passed, total, percent (null without pairs)."""
    passes = _passes(scored, attributes, thresholds or {})
    each = {**passes, "overall": _all(list(passes.values()))}
    counts = scored.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(f"p{k}") for k, c in enumerate(each.values())])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"p{k}").alias("passed")) for k, a in enumerate(each)])).alias("x")
    return counts.select("total", rows).select("x.attribute", "x.passed", "total", F.try_divide(F.col("x.passed") * 100.0, F.col("total")).alias("percent"))


def with_overall(scored: DataFrame, attributes: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """overall_similarity: weighted mean of the scores there are; equal weights by default, 0 if they sum to 0."""
    present = [a for a in attributes if f"{a}_sim" in scored.columns]
    weight = {a: (weights.get(a, 0.0) if weights is not None else 1 / len(attributes)) for a in present}
    total = sum(weight.values())
    value = sum((quoted(f"{a}_sim") * weight[a] for a in present), F.lit(0.0)) / total if total else F.lit(0.0)
    return scored.withColumn("overall_similarity", value.cast("double"))


def similarity_stats(scored: DataFrame, attributes: list[str], median_accuracy: int | None = None) -> DataFrame:
    """attribute, mean, std (0 for a single pair), min, max, median, count; zeros without pairs.

    The exact median brings all distinct similarities to one task; median_accuracy takes a quantile sketch of bounded size instead, off by
    at most 1 / median_accuracy of the ranks.
    """
    median = (lambda c: F.percentile_approx(c, 0.5, median_accuracy)) if median_accuracy else F.median
    present = [a for a in attributes if f"{a}_sim" in scored.columns]
    if not present:
        return scored.sparkSession.createDataFrame([], "attribute string, mean double, std double, min double, max double, median double, count long")
    # one aggregation over all columns: no unpivot of the pairs
    each = [F.struct(F.lit(a).alias("attribute"), *[F.coalesce(f(f"{a}_sim"), F.lit(0.0)).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max), ("median", median))], F.count(f"{a}_sim").alias("count")) for a in present]
    return scored.agg(F.array(*each).alias("all")).select(F.explode("all").alias("x")).select("x.*")


def with_positions(pairs: DataFrame) -> DataFrame:
    """pos of each exploded pair in the order of src_id and rank, for filter_by_thresholds_legacy."""
    from kinsift.operators.workspace import dense_index

    return dense_index(pairs.drop("pos"), "src_id", "rank", name="pos")


def best_match(scored: DataFrame, score: str = "overall_similarity") -> DataFrame:
    """The best scored pair of each source, ties by the smaller dst_id."""
    order = Window.partitionBy("src_id").orderBy(F.desc(score), "dst_id")
    return scored.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")
