"""Candidate pairs: neighbours taken apart, attributes of both records, distance filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsift.functions.columns import quoted
from kinsift.operators.blocking import alias, drop_blocking_columns, resolve_attributes


def explode_neighbors(df: DataFrame, id_column: str = "row_id", column: str = "neighbors") -> DataFrame:
    """src_id, dst_id, distance (0 if missing) and pos of each neighbour; null lists give none. Pairs are directed."""
    taken = df.select(F.col(id_column).alias("src_id"), F.posexplode(column).alias("pos", "n"))
    return taken.select("src_id", F.col("n.neighbor").alias("dst_id"), F.coalesce("n.distance", F.lit(0.0)).alias("distance"), "pos")


def enrich_pairs(pairs: DataFrame, records: DataFrame, attributes: list[str], id_column: str = "row_id") -> DataFrame:
    """src_id, dst_id, distance, then <a>_l and <a>_r of each attribute; pairs without a record keep nulls."""
    side = lambda key, suffix: records.select(F.col(id_column).alias(key), *[quoted(a).alias(f"{a}_{suffix}") for a in attributes])
    joined = pairs.join(side("src_id", "l"), "src_id", "left").join(side("dst_id", "r"), "dst_id", "left")
    kept = [c for c in ("src_id", "dst_id", "distance") if c in pairs.columns]
    return joined.select(*kept, *[quoted(f"{a}_{s}") for a in attributes for s in ("l", "r")])


def extract_pairs(neighbors: DataFrame, records: DataFrame, attributes: list[str] | None = None, id_column: str = "row_id") -> DataFrame:
    """Neighbours taken apart and enriched; attributes default to all that records have."""
    records = drop_blocking_columns(records)
    return enrich_pairs(explode_neighbors(neighbors, id_column), records, resolve_attributes(records, attributes), id_column)


def comparison_pairs(pairs: DataFrame, raw: DataFrame, features: list[str], id_column: str = "row_id") -> DataFrame:
    """Pairs with all left features, then all right ones."""
    side = lambda key, suffix: raw.select(F.col(id_column).alias(key), *[quoted(a).alias(f"{alias(a)}_{suffix}") for a in features])
    joined = pairs.join(side("src_id", "l"), "src_id", "left").join(side("dst_id", "r"), "dst_id", "left")
    return joined.select(*[c for c in pairs.columns], *[quoted(f"{alias(a)}_l") for a in features], *[quoted(f"{alias(a)}_r") for a in features])


def filter_by_distance(pairs: DataFrame, max_distance: float | None) -> DataFrame:
    """Pairs up to the distance; all pairs if there is no distance column or bound."""
    return pairs if max_distance is None or "distance" not in pairs.columns else pairs.where(F.col("distance") <= max_distance)


def clustering_distance(max_distance: float | None) -> float:
    """The stricter bound when edit similarity is off."""
    return min(0.7 * max_distance, 0.3) if max_distance else 0.3
