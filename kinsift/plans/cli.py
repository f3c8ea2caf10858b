"""python -m kinsift.plans.cli --data in.csv --output out: groups the records of a file."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from kinsift.config import PipelineConfig
from kinsift.operators.embedding import named_embedder
from kinsift.plans.pipeline import run
from kinsift.sources.records import assign_row_id, load_records, minimal_sample, save_records


def _thresholds(text: str) -> dict[str, float]:
    return {k: float(v) for k, _, v in (part.partition("=") for part in text.split(",") if part)}


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--data", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--features", nargs="*")
    p.add_argument("--create-sample", action="store_true", help="writes twenty records to --data first")
    p.add_argument("--model", default="hashed:256", help="hashed:<buckets>, or <module>:<function> that loads an encoder")
    p.add_argument("--index", choices=("tree", "centroids"), default="tree", help="how --use-partitions searches")
    p.add_argument("--use-partitions", "--use-apd", action="store_true")
    p.add_argument("--max-distance", "--threshold", type=float, default=0.8)
    p.add_argument("--k", type=int, default=20)
    p.add_argument("--no-levenshtein", action="store_true")
    p.add_argument("--thresholds", type=_thresholds, default={}, help="title=0.8,authors=0.7")
    p.add_argument("--num-blocking-cols", type=int, default=12)
    p.add_argument("--min-cluster-size", type=int, default=2)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("kinsift").getOrCreate()
    if a.create_sample:
        save_records(minimal_sample(spark), a.data, single_file=True)
    config = PipelineConfig(tuple(a.features) if a.features else None, a.num_blocking_cols, a.k, max_distance=a.max_distance, use_levenshtein=not a.no_levenshtein, thresholds=a.thresholds, min_cluster_size=a.min_cluster_size, use_partitions=a.use_partitions, index=a.index)
    result = run(assign_row_id(load_records(spark, a.data)), config, named_embedder(a.model))
    save_records(result.clusters, a.output)
    row = result.summary().first()
    print(f"{row.records} records in {row.clusters} clusters, {row.multi_clusters} of several records, in {result.seconds:.1f} s ({row.records / max(result.seconds, 1e-9):.1f} records a second)")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
