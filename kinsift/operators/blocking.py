"""Columns to match by, blocking keys, and names of attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsift.functions.columns import blocking_key, quoted

#: Columns that later stages add.
STAGE_COLUMNS = ("blockingKey", "features", "normFeatures", "row_id")


def alias(name: str) -> str:
    return name.replace(".", "#")


def select_features(df: DataFrame, features: list[str]) -> DataFrame:
    """The features, then id and row_id where there are such; dotted names get # for the dot."""
    wanted = [*features, *(c for c in ("id", "row_id") if c in df.columns and c not in features)]
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    return df.select(*[quoted(c).alias(alias(c)) for c in dict.fromkeys(wanted)])


def with_blocking_key(df: DataFrame, features: list[str], num_blocking_cols: int = 12) -> DataFrame:
    """The selected columns and blockingKey: the first features in the order given, joined by |."""
    selected = select_features(df, features)
    return selected.withColumn("blockingKey", blocking_key([quoted(alias(c)) for c in features[:num_blocking_cols]]))


def blocking_key_only(df: DataFrame, features: list[str], num_blocking_cols: int = 12) -> DataFrame:
    """As with_blocking_key, for tables that must have an id."""
    if "id" not in df.columns:
        raise KeyError("id")
    return with_blocking_key(df, features, num_blocking_cols)


def drop_blocking_columns(df: DataFrame) -> DataFrame:
    """Without blockingKey and normFeatures; features stay."""
    return df.drop("blockingKey", "normFeatures")


def resolve_attributes(df: DataFrame, selected: list[str] | None = None) -> list[str]:
    """Selected attributes that the table has, in that order; all its attributes if none is selected or left. id is never one by default."""
    available = [c for c in df.columns if c not in STAGE_COLUMNS]
    chosen = [alias(c) for c in selected or [] if alias(c) in available]
    return chosen or [c for c in available if c.lower() != "id"]


def match_namespaced(columns: list[str], names: list[str], namespace: str = "_crm", limit: int = 12) -> tuple[list[str], list[str]]:
    """For dotted canonical names: the first column that has the last part and the namespace in its name, or is that name. Found ones (at most limit) and missing names."""
    found, missing = [], []
    for name in names:
        part = name.rsplit(".", 1)[-1]
        hit = next((c for c in columns if (part.lower() in c.lower() and namespace.lower() in c.lower()) or c == name), None)
        (missing if hit is None else found).append(name if hit is None else hit)
    return found[:limit], missing


def match_attributes(columns: list[str], names: list[str], limit: int = 12) -> tuple[list[str], list[str]]:
    """For canonical names: the first column that holds the name or is held by it, case apart. Found ones (at most limit) and missing names."""
    found, missing = [], []
    for name in names:
        hit = next((c for c in columns if name.lower() in c.lower() or c.lower() in name.lower()), None)
        (missing if hit is None else found).append(name if hit is None else hit)
    return found[:limit], missing


def overview(df: DataFrame) -> DataFrame:
    """records and columns of a table, as one row."""
    return df.agg(F.count(F.lit(1)).alias("records")).withColumn("columns", F.lit(len(df.columns)).cast("long"))
