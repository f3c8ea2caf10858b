"""The queries of this subpackage and, where SQL can express them over whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .components import p3_found
from .contamination import p8_found
from .names import p1_entities, p1_found
from .records import p6_found, p6_groups
from .subjects import p9_found
from .survivors import p2_found, p2_values
from .tokenize import encode_corpus
from .vectors import p5_found
from .venues import duckdb_sql, p4_found


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found}
    # classes beside the pairs, and all values judged true beside the surviving ones
    return {**found, "p1_entities": p1_entities, "p2_values": p2_values, "p6_groups": p6_groups}


#: The recursive query walks from each record to every record that it reaches.
P3_SQL = """
WITH RECURSIVE links AS (
  SELECT DISTINCT p.src_id AS a, p.dst_id AS b FROM candidate_pairs p
  WHERE p.src_id <> p.dst_id AND p.src_id IN (SELECT row_id FROM results) AND p.dst_id IN (SELECT row_id FROM results)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS row_id, a AS other FROM both_ways UNION SELECT r.row_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a)
SELECT row_id, min(other) AS group_id FROM reach GROUP BY row_id
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_SQL, "p4_found": duckdb_sql()}
