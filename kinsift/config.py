"""Settings of the pipeline, all in one place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PipelineConfig:
    """features: columns to match by (None: detected). max_distance is an upper bound, smaller is stricter. missing: 'nan' compares missing values as that text, 'zero' gives them similarity 0.

    index: how use_partitions searches: 'tree' (spilled hyperplane partitions) or 'centroids' (an inverted file whose search width is set
    by least_recall). max_tree_depth=None takes the depth from the number of rows.
    """

    features: tuple[str, ...] | None = None
    num_blocking_cols: int = 12
    k: int = 20
    metric: str = "cosine"
    max_distance: float | None = 0.8
    use_levenshtein: bool = True
    thresholds: dict[str, float] = field(default_factory=dict)
    default_threshold: float = 0.7
    missing: str = "nan"
    legacy_alignment: bool = False
    min_cluster_size: int = 2
    use_partitions: bool = False
    index: str = "tree"
    least_recall: float = 0.95
    sample_size: int = 100_000
    max_tree_depth: int | None = 6
    min_leaf_size: int = 1000
    spill_alpha: float = 0.3
    buckets: int = 256
