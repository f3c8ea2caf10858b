"""Small helpers of this subpackage; shared folder and written tables are the engine's."""

from __future__ import annotations

import os

from kinsift.operators.workspace import Workspace, parallelism, shared_dir
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["Workspace", "is_blank", "meet", "parallelism", "shared_dir", "table"]

#: Rows of one key that meet in one task; keys with more are split.
KEY_ROWS = 5_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def is_blank(column) -> Column:
    """True for null and for text of white space only, no-break spaces included."""
    return column.isNull() | (F.length(F.regexp_replace(column, r"[\s\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]+", "")) == 0)


def meet(space: Workspace, left: DataFrame, right: DataFrame, key: str, row: str, key_rows: int = KEY_ROWS) -> DataFrame:
    """left joined with right on key, where row is an id that only left has. Keys that more than key_rows rows of right have are split: their left rows are
    spread over salts by row, and their right rows are copied to each salt, so that no pair is lost and none comes twice. The hot keys are written, so Spark knows their size before it
    chooses a join for them."""
    hot = space.write(right.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > key_rows).select(key, F.ceil(F.col("_n") / key_rows).cast("int").alias("_salts")))
    if hot.isEmpty():  # no key to split: the same rows without salts
        return left.join(right, key)
    salts = F.coalesce("_salts", F.lit(1))
    spread = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(row), salts).cast("int")).drop("_salts")
    copied = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return spread.join(copied, [key, "_salt"]).drop("_salt")
