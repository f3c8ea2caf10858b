"""Arriving records against a fixed reference table: equal blocking keys are paired and scored, in any micro-batch or batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinsift.functions.columns import blocking_key, comparable, quoted, similarity_of_lowered
from kinsift.operators.similarity import filter_by_thresholds
from kinsift.operators.workspace import parallelism

#: Ids of equal records that one row holds at most.
MOST_IDS = 4096
#: Types of attributes whose equal values are the same value, so that equal records can share a row; others (-0.0 and 0.0, an hour that comes twice, maps) stay apart.
_SAME_IF_EQUAL = (T.IntegralType, T.BooleanType, T.DateType, T.DecimalType)


def score_arrivals(arrivals: DataFrame, reference: DataFrame, block_by: list[str], attributes: list[str], thresholds: dict[str, float] | None = None, id_column: str = "row_id") -> DataFrame:
    """src_id, dst_id, the attributes of both and their similarities, for pairs that reach all thresholds. A stateless stream-static join; records without a value in block_by match none.

    Records with equal blocks and attributes are scored as one and their ids paired afterwards; arrivals of a stream one by one, since grouping them would need state.
    """
    left, right = (_alike(df, block_by, attributes, id_column, s) for df, s in ((arrivals, "l"), (reference, "r")))
    each = lambda a, s: (F.col(f"`__{a}_{s}`.low"), F.col(f"`__{a}_{s}`.length"))
    scores = [similarity_of_lowered(*each(a, "l"), *each(a, "r")).alias(f"{a}_sim") for a in attributes]
    texts = [quoted(f"{a}_{s}") for s in ("l", "r") for a in attributes]
    scored = filter_by_thresholds(left.join(right, "_block").select("_ids_l", "_ids_r", *texts, *scores), attributes, thresholds)
    pairs = scored.withColumn("_l", F.explode("_ids_l")).withColumn("_r", F.explode("_ids_r"))
    side = lambda s: [quoted(f"{a}_{s}") for a in attributes]
    return pairs.select(F.col("_l.id").alias("src_id"), *side("l"), F.col("_r.id").alias("dst_id"), *side("r"), *[quoted(f"{a}_sim") for a in attributes])


def _alike(df: DataFrame, block_by: list[str], attributes: list[str], id_column: str, suffix: str) -> DataFrame:
    """_block, the attributes, their lowered texts with the lengths before that, and _ids: those of the records that have them (in structs, so null ids stay), MOST_IDS a row."""
    texts = [f"{a}_{suffix}" for a in attributes]
    rows = df.dropna(subset=block_by).select(F.struct(F.col(id_column).alias("id")).alias("_id"), blocking_key([quoted(b) for b in block_by]).alias("_block"), *[quoted(a).alias(t) for a, t in zip(attributes, texts, strict=True)])
    same = all(f.dataType == T.StringType() or isinstance(f.dataType, _SAME_IF_EQUAL) for f in rows.schema[2:])
    if same and not df.isStreaming:
        # one shuffle for grouping and join, of a number of partitions that isn't cut to the small size of their input: work grows with the pairs
        rows, keys = rows.repartition(parallelism(df.sparkSession), "_block"), [F.col("_block"), *map(quoted, texts)]
        part = F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))) - 1) / MOST_IDS)
        rows = rows.withColumn("_part", part).groupBy(*keys, "_part").agg(F.collect_list("_id").alias(f"_ids_{suffix}"))
    else:
        rows = rows.withColumn(f"_ids_{suffix}", F.array("_id"))
    text = lambda t: comparable(quoted(t))
    return rows.select("_block", f"_ids_{suffix}", *map(quoted, texts), *[F.struct(F.lower(text(t)).alias("low"), F.length(text(t)).alias("length")).alias(f"__{t}") for t in texts])
