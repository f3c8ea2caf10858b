"""The engine's registered queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsift.config import PipelineConfig
from kinsift.functions.columns import _SPACES, hashed_ngrams, name_variants, title_variants, unit
from kinsift.operators import blocking, clusters, neighbors, pairs, partitioning, reports, similarity
from kinsift.operators.embedding import hashed_embedder, with_features
from kinsift.operators.workspace import Workspace
from kinsift.plans.pipeline import run
from kinsift.sources import records
from kinsift.streaming.scoring import score_arrivals

Query = Callable[[SparkSession, str], DataFrame]
K, NEAR = 20, 0.62
#: Spill of the registered approx_knn, at which recall against exact search is 0.9 or more (README).
SPILL_ALPHA = 0.3
#: A fixed tree over the first three axes.
AXIS_TREE = lambda: partitioning.number_leaves(
    partitioning.Node(-1, _axis(0), 0.0, 0.8, partitioning.Node(-1, _axis(1), 0.05, 0.8, partitioning.Node(), partitioning.Node()), partitioning.Node(-1, _axis(2), -0.05, 0.8, partitioning.Node(), partitioning.Node()))
)
ATTRIBUTES = ["title", "venue", "year"]
THRESHOLDS = {"title": 0.5, "venue": 0.3, "year": 0.5}
WEIGHTS = {"title": 0.5, "venue": 0.3, "year": 0.2}
WIDE_CONFIG = PipelineConfig(("title", "authors", "venue", "year"), 4, 10, max_distance=0.5, thresholds={"title": 0.8, "authors": 0.5, "venue": 0.6, "year": 0.9}, use_partitions=True, index="centroids")


def _axis(n: int) -> list[float]:
    return [1.0 if k == n else 0.0 for k in range(64)]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("normFeatures"), "label")


def _knn(spark: SparkSession, d: str, **options) -> DataFrame:
    return neighbors.exact_knn(_vectors(spark, d), K, **options)


def _near(spark: SparkSession, d: str) -> DataFrame:
    return pairs.filter_by_distance(_knn(spark, d), NEAR).select("src_id", "dst_id", "distance")


def _labelled(spark: SparkSession, d: str, size: int = 2) -> DataFrame:
    near = Workspace(spark, "near").write(_near(spark, d))
    return clusters.label_clusters(_vectors(spark, d).select("row_id", "label"), near, size)


def _typed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Directed pairs with their attributes as stored, in any script; scores need no ids, so pairs with a null id stay."""
    return _t(spark, d, "candidate_pairs").select("src_id", "dst_id", "distance", *(f"{a}_{s}" for a in ATTRIBUTES for s in ("l", "r")))


def _scored(spark: SparkSession, d: str, missing: str = "nan") -> DataFrame:
    return similarity.with_similarities(_typed_pairs(spark, d), ATTRIBUTES, missing)


def _rounded(df: DataFrame, *columns: str, to: int = 6) -> DataFrame:
    return df.select(*[F.round(c, to).alias(c) if c in columns else F.col(c) for c in df.columns])


def _names(spark: SparkSession, names: list[str], column: str = "column_name") -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


def _csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    nation = _t(spark, d, "nation")
    path = Workspace(spark, "csv").root
    records.save_records(nation, path)
    return records.load_records(spark, path, nation.schema)


def _load_row_ids(spark: SparkSession, d: str) -> DataFrame:
    """Row ids by position in a file; the one that the file brings along is replaced."""
    path = Workspace(spark, "csv").root
    records.save_records(_t(spark, d, "nation").orderBy("n_nationkey").withColumn("row_id", F.lit(7)), path, single_file=True)
    return records.assign_row_id(records.load_records(spark, path)).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", "row_id")


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select("c_custkey", F.posexplode(name_variants(F.concat_ws(" ", "c_mktsegment", F.concat(F.lit("Customer"), "c_custkey")), F.lit("Q"))).alias("pos", "variant"))


def _unit_values(spark: SparkSession, d: str) -> DataFrame:
    doubled = _t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x * 2).alias("features"))
    return doubled.select("vec_id", F.posexplode(unit(F.col("features"))).alias("pos", "value")).select("vec_id", "pos", F.round(F.col("value").cast("double"), 5).alias("value"))


def _wide_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: publications of wide_records grouped by title, authors, venue and year."""
    return run(_t(spark, d, "wide_records"), WIDE_CONFIG).clusters.select("row_id", "id", "title", "authors", "venue", "year", "cluster_id")


def _part_vectors(spark: SparkSession, d: str) -> DataFrame:
    return with_features(blocking.with_blocking_key(_t(spark, d, "part").withColumnRenamed("p_partkey", "id"), ["p_name", "p_brand", "p_type"]), hashed_embedder(64))


def _model(spark: SparkSession, d: str, settings: neighbors.NearestNeighbors, column: str = "neighbors") -> DataFrame:
    table = _vectors(spark, d)
    return settings.fit(table).transform(table).select("row_id", "label", F.posexplode(column).alias("pos", "n")).select("row_id", "label", "pos", F.col("n.neighbor").alias("neighbor"), F.round("n.distance", 6).alias("distance"))


def _learned(spark: SparkSession, d: str) -> tuple[DataFrame, partitioning.Node]:
    v = _vectors(spark, d)
    return v, partitioning.learn_tree(v, max_tree_depth=4, min_leaf_size=50)


def _compare(spark: SparkSession, d: str) -> DataFrame:
    space = Workspace(spark, "methods")
    near = space.write(pairs.enrich_pairs(pairs.filter_by_distance(_knn(spark, d), 0.65), _vectors(spark, d), ["label"]))
    strict = similarity.filter_by_thresholds(similarity.with_similarities(near, ["label"]), ["label"], {"label": 0.9})
    rows = _vectors(spark, d).select("row_id")
    return reports.compare_methods(space.write(clusters.label_clusters(rows, strict)), space.write(clusters.label_clusters(rows, near)))


def queries() -> dict[str, Query]:
    v, spilled = _vectors, lambda s, d: partitioning.spill_partitions(_vectors(s, d), AXIS_TREE(), 0.1)
    placed = lambda s, d: partitioning.assign_partition(_vectors(s, d), AXIS_TREE())
    nested = lambda s, d: neighbors.nest_neighbors(_knn(s, d))
    return {
        "detect_features_events": lambda s, d: _names(s, records.detect_features(_t(s, d, "events"))),
        "detect_features_part": lambda s, d: _names(s, records.detect_features(_t(s, d, "part"))),
        "row_ids": lambda s, d: records.assign_row_id(_t(s, d, "part"), "p_partkey").select("p_partkey", "row_id"),
        "csv_round_trip": _csv_round_trip,
        "load_row_ids": _load_row_ids,
        "minimal_sample": lambda s, d: records.minimal_sample(s),
        "synthetic_records": lambda s, d: records.synthetic_records(s),
        "name_variants": _customers,
        "title_variants": lambda s, d: _t(s, d, "part").select("p_partkey", F.posexplode(title_variants(F.col("p_name"))).alias("pos", "variant")),
        "match_attributes": lambda s, d: _names(s, blocking.match_attributes(_t(s, d, "wide_records").columns, ["title", "author", "venue", "year", "language", "country", "institution", "publisher", "issue", "keywords", "abstract", "funding"])[0]),
        "match_namespaced": lambda s, d: _names(s, blocking.match_namespaced([f"acct_crm.{c}" for c in _t(s, d, "customer").columns], ["_crm.C_NAME", "_crm.c_mktsegment", "_crm.zip", "_crm.c_acctbal"])[0]),
        "select_features": lambda s, d: blocking.select_features(_t(s, d, "part").withColumnRenamed("p_name", "p.name"), ["p.name", "p_brand"]),
        "blocking_key": lambda s, d: blocking.with_blocking_key(_t(s, d, "part"), ["p_name", "p_brand", "p_type", "p_size"], 3).select("p_name", "p_size", "blockingKey"),
        "blocking_key_nulls": lambda s, d: blocking.blocking_key_only(_t(s, d, "part").select(F.col("p_partkey").alias("id"), "p_name", F.nullif("p_brand", F.lit("Brand#11")).alias("p_brand"), "p_size"), ["p_name", "p_brand", "p_size"]).select("id", "blockingKey"),
        "hashed_ngrams": lambda s, d: _t(s, d, "part").select("p_partkey", F.explode(hashed_ngrams(F.concat_ws("|", "p_name", "p_brand"))).alias("bucket")).groupBy("p_partkey", "bucket").agg(F.count(F.lit(1)).alias("n")).select("p_partkey", F.col("bucket").cast("long").alias("bucket"), "n"),
        "hashed_embedding": lambda s, d: _part_vectors(s, d).select("id", "normFeatures", F.posexplode("features").alias("bucket", "n")).where("n > 0").select("id", F.col("bucket").cast("long").alias("bucket"), F.col("n").cast("long").alias("n"), F.round(F.element_at("normFeatures", F.col("bucket") + 1).cast("double"), 5).alias("part")),
        "l2_norm": _unit_values,
        "assign_partition": lambda s, d: placed(s, d).select("row_id", "partition_id"),
        "spill_partitions": lambda s, d: spilled(s, d).select("row_id", F.explode("queryPartitions").alias("partition_id")),
        "partition_counts": lambda s, d: partitioning.partition_counts(placed(s, d)),
        "spill_widths": lambda s, d: partitioning.spill_widths(spilled(s, d)),
        "distinct_partitions": lambda s, d: reports.distinct_count(placed(s, d), "partition_id", "partitions"),
        "learn_tree": lambda s, d: partitioning.assign_partition(*_learned(s, d)).select("row_id", "partition_id"),
        "approx_knn": lambda s, d: neighbors.approx_knn(*_learned(s, d), K, SPILL_ALPHA).select("src_id", "dst_id", F.round("distance", 6).alias("distance")),
        "knn_cosine": lambda s, d: _rounded(_knn(s, d), "distance"),
        "knn_sqeuclidean": lambda s, d: _rounded(_knn(s, d, metric="sqeuclidean"), "distance"),
        "knn_nonzero": lambda s, d: _rounded(_knn(s, d, metric="sqeuclidean", drop_zero_distance=True), "distance"),
        "centroid_knn": lambda s, d: neighbors.centroid_knn(v(s, d), K, cell_rows=128).select("src_id", "dst_id", F.round("distance", 6).alias("distance")),
        "neighbors_model": lambda s, d: _model(s, d, neighbors.NearestNeighbors(K)),
        "neighbors_model_sqeuclidean": lambda s, d: _model(s, d, neighbors.NearestNeighbors(K, metric="sqeuclidean", drop_zero_distance=True, prediction_col="near"), "near"),
        "explode_pairs": lambda s, d: _rounded(pairs.explode_neighbors(nested(s, d)).drop("pos"), "distance"),
        "enrich_pairs": lambda s, d: _rounded(pairs.extract_pairs(nested(s, d), v(s, d), ["label"]), "distance"),
        "comparison_pairs": lambda s, d: _rounded(pairs.comparison_pairs(_near(s, d), v(s, d), ["label", "row_id"]), "distance"),
        "distance_filter": lambda s, d: _rounded(_near(s, d), "distance"),
        "clustering_filter": lambda s, d: pairs.filter_by_distance(_t(s, d, "candidate_pairs").dropna(subset=["src_id", "dst_id"]).select("src_id", "dst_id", "distance"), pairs.clustering_distance(0.2)),
        "lev_similarity": lambda s, d: _rounded(_scored(s, d).select("src_id", "dst_id", "title_sim", "venue_sim", "year_sim"), "title_sim", "venue_sim", "year_sim"),
        "lev_missing_zero": lambda s, d: _rounded(_scored(s, d, "zero").select("src_id", "dst_id", "title_sim", "venue_sim", "year_sim"), "title_sim", "venue_sim", "year_sim"),
        "attribute_thresholds": lambda s, d: similarity.filter_by_thresholds(_scored(s, d), ATTRIBUTES, THRESHOLDS).select("src_id", "dst_id"),
        "pass_rates": lambda s, d: _rounded(similarity.pass_rates(_scored(s, d), ATTRIBUTES, THRESHOLDS), "percent"),
        "overall_similarity": lambda s, d: _rounded(similarity.with_overall(_scored(s, d), ATTRIBUTES, WEIGHTS).select("src_id", "dst_id", "overall_similarity"), "overall_similarity"),
        "similarity_stats": lambda s, d: _rounded(similarity.similarity_stats(_scored(s, d), ATTRIBUTES), "mean", "std", "min", "max", "median"),
        "connected_components": lambda s, d: clusters.connected_components(_near(s, d)),
        "components_candidate_pairs": lambda s, d: clusters.connected_components(_t(s, d, "candidate_pairs").select("src_id", "dst_id")),
        "cluster_labels": lambda s, d: _labelled(s, d),
        "min_cluster_size": lambda s, d: _labelled(s, d, 3),
        "cluster_sizes": lambda s, d: reports.cluster_sizes(_labelled(s, d)),
        "cluster_summary": lambda s, d: reports.cluster_summary(_labelled(s, d)),
        "distinct_clusters": lambda s, d: reports.distinct_count(_labelled(s, d), "cluster_id", "clusters"),
        "cluster_size_hist": lambda s, d: _rounded(reports.cluster_size_histogram(_labelled(s, d)), "low", "high"),
        "distance_hist": lambda s, d: _rounded(reports.distance_histogram(_t(s, d, "candidate_pairs")), "low", "high"),
        "top_clusters": lambda s, d: reports.top_clusters(_labelled(s, d).withColumn("member", F.col("row_id"))),
        "neighbor_count": lambda s, d: reports.neighbor_count(nested(s, d)),
        "mean_distance": lambda s, d: _rounded(reports.mean_distance(_t(s, d, "candidate_pairs")), "mean_distance"),
        "compare_methods": _compare,
        "overview": lambda s, d: blocking.overview(_t(s, d, "part")),
        "column_ranges": lambda s, d: reports.column_ranges(_t(s, d, "wide_records"), ["year", "volume", "issue", "citation_count", "h_index"]),
        "head_preview": lambda s, d: reports.head(_t(s, d, "part").select("p_partkey", "p_name"), "p_partkey"),
        "stream_scoring": lambda s, d: _rounded(score_arrivals(_t(s, d, "part"), _t(s, d, "part"), ["p_brand", "p_size"], ["p_name", "p_type"], {"p_name": 0.5, "p_type": 0.3}, "p_partkey").select("src_id", "dst_id", "p_name_sim", "p_type_sim"), "p_name_sim", "p_type_sim"),
        "pipeline_e2e": _wide_pipeline,
    }


def _knn_cte(distance: str = "1 - list_cosine_similarity(a.v, b.v)", keep: str = "true") -> str:
    return f"""e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
d AS (SELECT a.id AS src_id, b.id AS dst_id, round({distance}, 9) AS distance FROM e a, e b WHERE a.id <> b.id),
knn AS (SELECT * FROM (SELECT src_id, dst_id, distance, row_number() OVER (PARTITION BY src_id ORDER BY distance, dst_id) AS rank FROM d WHERE {keep}) WHERE rank <= {K})"""


_SQUARED = "list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"


def _components(near: str = "near", tag: str = "") -> str:
    return f"""both_ways{tag} AS (SELECT src_id AS a, dst_id AS b FROM {near} UNION SELECT dst_id, src_id FROM {near}),
reach{tag} AS (SELECT a AS node, b AS other FROM both_ways{tag} UNION SELECT a, a FROM both_ways{tag} UNION SELECT r.node, e.b FROM reach{tag} r JOIN both_ways{tag} e ON r.other = e.a),
comp{tag} AS (SELECT node, min(other) AS component FROM reach{tag} GROUP BY node)"""


def _near_cte(bound: float = NEAR) -> str:
    return f"{_knn_cte()}, near AS (SELECT * FROM knn WHERE distance <= {bound}), {_components()}"


def _numbered_cte(ids: str, size: int = 2) -> str:
    """Cluster numbers of the components of near, and after them one each for the other ids of a table."""
    return f"""sized AS (SELECT component FROM comp GROUP BY component HAVING count(*) >= {size}),
firsts AS (SELECT c.component, min(n.src_id) AS first_src FROM near n JOIN comp c ON n.src_id = c.node GROUP BY c.component),
numbered AS (SELECT s.component, row_number() OVER (ORDER BY f.first_src) - 1 AS cluster_id FROM sized s JOIN firsts f USING (component)),
multi AS (SELECT c.node AS row_id, n.cluster_id FROM comp c JOIN numbered n USING (component)),
single AS (SELECT id AS row_id, (SELECT count(*) FROM numbered) + row_number() OVER (ORDER BY id) - 1 AS cluster_id FROM {ids} WHERE id NOT IN (SELECT row_id FROM multi))"""


def _labelled_cte(size: int = 2) -> str:
    return f"""{_near_cte()},
{_numbered_cte("e", size)},
labelled AS (SELECT m.row_id, m.cluster_id, e.label FROM (SELECT * FROM multi UNION ALL SELECT * FROM single) m JOIN e ON e.id = m.row_id),
sizes AS (SELECT cluster_id, count(*) AS size FROM labelled GROUP BY cluster_id)"""


def _scores(source: str, attributes: list[str], keep: str, missing: str = "nan") -> str:
    """CTEs that end in scored: the kept columns of a table and <a>_sim, from <a>_l and <a>_r in code points. DuckDB's levenshtein counts bytes, so the letters of a pair are numbered first: each becomes one ASCII character."""
    each = [(a, s) for a in attributes for s in ("l", "r")]
    letters = lambda c: f"list_transform(range(1, length({c}) + 1), lambda i: {c}[i])"
    trimmed = ", ".join(f"trim(coalesce(CAST({a}_{s} AS VARCHAR), '{missing}'), '{_SPACES}') AS {a}_t{s}" for a, s in each)
    lower = ", ".join(f"lower({a}_t{s}) AS {a}_w{s}" for a, s in each)
    known = ", ".join(f"list_distinct(list_concat({letters(f'{a}_wl')}, {letters(f'{a}_wr')})) AS {a}_k" for a in attributes)
    coded = ", ".join(f"array_to_string(list_transform({letters(f'{a}_w{s}')}, lambda c: chr(list_position({a}_k, c)::INT)), '') AS {a}_c{s}" for a, s in each)
    scores = ", ".join(f"CASE WHEN {a}_tl = '' OR {a}_tr = '' THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - levenshtein({a}_cl, {a}_cr)::DOUBLE / greatest(length({a}_tl), length({a}_tr))) END AS {a}_sim" for a in attributes)
    return f"""s1 AS MATERIALIZED (SELECT {keep}, {trimmed} FROM {source}), s2 AS MATERIALIZED (SELECT *, {lower} FROM s1), s3 AS MATERIALIZED (SELECT *, {known} FROM s2),
s4 AS MATERIALIZED (SELECT *, {coded} FROM s3), scored AS (SELECT {keep}, {scores} FROM s4)"""


def _scored_cte(missing: str = "nan") -> str:
    return _scores("candidate_pairs", ATTRIBUTES, "src_id, dst_id", missing)


def _pipeline_sql() -> str:
    """The flagship with exact neighbours; the same where a table has rows for one cell only."""
    c = WIDE_CONFIG
    key = " || '|' || ".join(f"coalesce(CAST({f} AS VARCHAR), '')" for f in c.features or ())
    sides = ", ".join(f"l.{f} AS {f}_l, r.{f} AS {f}_r" for f in c.features or ())
    passes = " AND ".join(f"{f}_sim >= {c.thresholds[f]}" for f in c.features or ())
    return f"""WITH RECURSIVE e AS (SELECT row_id::BIGINT AS id, lower({key}) AS k FROM wide_records),
g AS (SELECT id, unnest(list_transform(range(1, greatest(length(k) - 2, 1) + 1), lambda i: substr(k, i, 3))) AS gram FROM e WHERE k <> ''),
h AS (SELECT id, ('0x' || substr(md5(gram), 1, 6))::BIGINT % {c.buckets} AS bucket, count(*)::DOUBLE AS n FROM g GROUP BY ALL),
u AS (SELECT id, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS x FROM h),
w AS (SELECT id, bucket, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM u),
d AS (SELECT a.id AS src_id, b.id AS dst_id, round(1 - sum(a.x * b.x), 9) AS distance FROM w a JOIN w b ON a.bucket = b.bucket AND a.id <> b.id GROUP BY ALL),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY distance, dst_id) AS rank FROM d) WHERE rank <= {c.k} AND distance <= {c.max_distance}),
sides AS (SELECT src_id, dst_id, {sides} FROM knn JOIN wide_records l ON l.row_id = src_id JOIN wide_records r ON r.row_id = dst_id),
{_scores("sides", list(c.features or ()), "src_id, dst_id")},
near AS (SELECT src_id, dst_id FROM scored WHERE {passes}),
{_components()},
{_numbered_cte("e", c.min_cluster_size)}
SELECT r.row_id, r.id, r.title, r.authors, r.venue, r.year, m.cluster_id FROM wide_records r JOIN (SELECT * FROM multi UNION ALL SELECT * FROM single) m ON m.row_id = r.row_id"""


_PASS = " AND ".join(f"{a}_sim >= {t}" for a, t in THRESHOLDS.items())
_TREE = "CASE WHEN embedding[1]::DOUBLE <= 0 THEN CASE WHEN embedding[2]::DOUBLE <= 0.05 THEN 0 ELSE 1 END ELSE CASE WHEN embedding[3]::DOUBLE <= -0.05 THEN 2 ELSE 3 END END"
_SPILL = """reached AS (
  SELECT vec_id, embedding[1]::DOUBLE <= 0 OR abs(embedding[1]::DOUBLE) <= 0.1 * 0.8::DOUBLE AS l, embedding[1]::DOUBLE > 0 OR abs(embedding[1]::DOUBLE) <= 0.1 * 0.8::DOUBLE AS r,
    embedding[2]::DOUBLE - 0.05::DOUBLE AS p, embedding[3]::DOUBLE + 0.05::DOUBLE AS q FROM embeddings
), spilled AS (
  SELECT vec_id AS row_id, 0 AS partition_id FROM reached WHERE l AND (p <= 0 OR abs(p) <= 0.08::DOUBLE)
  UNION ALL SELECT vec_id, 1 FROM reached WHERE l AND (p > 0 OR abs(p) <= 0.08::DOUBLE)
  UNION ALL SELECT vec_id, 2 FROM reached WHERE r AND (q <= 0 OR abs(q) <= 0.08::DOUBLE)
  UNION ALL SELECT vec_id, 3 FROM reached WHERE r AND (q > 0 OR abs(q) <= 0.08::DOUBLE)
)"""


def _hist(source: str, column: str, bins: str) -> str:
    return f"""WITH {source}, lim AS (SELECT min({column})::DOUBLE AS least, max({column})::DOUBLE AS most, {bins} AS bins FROM src WHERE {column} IS NOT NULL),
w AS (SELECT least, most, bins, (most - least) / bins AS width FROM lim),
b AS (SELECT CASE WHEN most = least THEN 1 ELSE least(floor(({column} - least) / width) + 1, bins) END::BIGINT AS bin, least, width FROM src, w WHERE {column} IS NOT NULL)
SELECT bin, round(any_value(least) + (bin - 1) * any_value(width), 6) AS low, round(any_value(least) + bin * any_value(width), 6) AS high, count(*) AS count FROM b GROUP BY bin"""


def _short_titles() -> str:
    from kinsift.functions.columns import TITLE_PREFIXES, TITLE_SHORT, TITLE_SUFFIXES

    forms = ["p_name", *[f"CASE WHEN contains(p_name, '{a}') THEN replace(p_name, '{a}', '{b}') END" for a, b in TITLE_SHORT.items()]]
    forms.append("CASE WHEN regexp_matches(p_name, '^(A|An|The) ') THEN regexp_replace(p_name, '^(A|An|The) ', '') ELSE 'A ' || p_name END")
    forms += [f"p_name || '{s}'" for s in TITLE_SUFFIXES] + [f"'{p}' || p_name" for p in TITLE_PREFIXES]
    return f"SELECT p_partkey, unnest(range(len(f)))::INT AS pos, unnest(f) AS variant FROM (SELECT p_partkey, list_filter([{', '.join(forms)}], lambda x: x IS NOT NULL) AS f FROM part)"


def oracle_sql() -> dict[str, str]:
    described = "SELECT column_name FROM (DESCRIBE SELECT * FROM {0}) WHERE column_name NOT ILIKE '%id'"
    full, grams = "c_mktsegment || ' Customer' || c_custkey", "lower(p_name || '|' || p_brand)"
    g, f = "split_part(n, ' ', 1)", "split_part(n, ' ', 2)"
    sims = ", ".join(f"round({a}_sim, 6) AS {a}_sim" for a in ATTRIBUTES)
    stats = " UNION ALL ".join(f"SELECT '{a}' AS attribute, round(coalesce(avg({a}_sim), 0), 6) AS mean, round(coalesce(stddev_samp({a}_sim), 0), 6) AS std, round(coalesce(min({a}_sim), 0), 6) AS min, round(coalesce(max({a}_sim), 0), 6) AS max, round(coalesce(median({a}_sim), 0)::DOUBLE, 6) AS median, count({a}_sim) AS count FROM scored" for a in ATTRIBUTES)
    rates = " UNION ALL ".join(f"SELECT '{a}' AS attribute, count(*) FILTER ({c}) AS passed, count(*) AS total, round(count(*) FILTER ({c}) * 100.0::DOUBLE / count(*), 6) AS percent FROM scored" for a, c in [*((a, f"{a}_sim >= {t}") for a, t in THRESHOLDS.items()), ("overall", _PASS)])
    part_lev = lambda c: f"CASE WHEN trim(a.{c}) = '' OR trim(b.{c}) = '' THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - levenshtein(lower(trim(a.{c})), lower(trim(b.{c})))::DOUBLE / greatest(length(trim(a.{c})), length(trim(b.{c})))) END"
    return {
        "detect_features_events": described.format("events"),
        "detect_features_part": described.format("part"),
        "row_ids": "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS row_id FROM part",
        "csv_round_trip": "SELECT * FROM nation",
        "minimal_sample": f"SELECT 'id_' || i AS id, {list(records.SAMPLE_TITLES)}[i // 5 + 1] AS title, {list(records.SAMPLE_AUTHORS)}[i // 5 + 1] AS authors, {list(records.SAMPLE_VENUES)}[i // 10 + 1] AS venue, 2020 AS year FROM range(20) t(i)",
        "name_variants": f"SELECT c_custkey, unnest(range(8))::INT AS pos, unnest([{g} || ' ' || {f}, {g}[1] || '. ' || {f}, {g} || ' ' || {f}[1] || '.', {g}[1] || '. ' || {f}[1] || '.', {f} || ', ' || {g}, {f} || ', ' || {g}[1] || '.', {g} || ' Q. ' || {f}, {g}[1] || '. Q. ' || {f}]) AS variant FROM (SELECT c_custkey, {full} AS n FROM customer)",
        "title_variants": _short_titles(),
        "match_attributes": "WITH cols AS (SELECT row_number() OVER () AS n, column_name FROM (DESCRIBE SELECT * FROM wide_records)), names AS (SELECT unnest(['title', 'author', 'venue', 'year', 'language', 'country', 'institution', 'publisher', 'issue', 'keywords', 'abstract', 'funding']) AS name) SELECT arg_min(column_name, n) AS column_name FROM names JOIN cols ON contains(lower(column_name), name) OR contains(name, lower(column_name)) GROUP BY name",
        "match_namespaced": "SELECT 'acct_crm.' || column_name AS column_name FROM (DESCRIBE SELECT * FROM customer) WHERE column_name IN ('c_name', 'c_mktsegment', 'c_acctbal')",
        "load_row_ids": "SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS row_id FROM nation",
        "select_features": 'SELECT p_name AS "p#name", p_brand FROM part',
        "blocking_key": "SELECT p_name, p_size, coalesce(p_name, '') || '|' || coalesce(p_brand, '') || '|' || coalesce(p_type, '') AS \"blockingKey\" FROM part",
        "blocking_key_nulls": "SELECT p_partkey AS id, coalesce(p_name, '') || '|' || coalesce(nullif(p_brand, 'Brand#11'), '') || '|' || coalesce(CAST(p_size AS VARCHAR), '') AS \"blockingKey\" FROM part",
        "hashed_ngrams": f"WITH g AS (SELECT p_partkey, unnest(list_transform(range(1, greatest(length({grams}) - 2, 1) + 1), lambda i: substr({grams}, i, 3))) AS gram FROM part) SELECT p_partkey, (('0x' || substr(md5(gram), 1, 6))::BIGINT % 256) AS bucket, count(*) AS n FROM g GROUP BY ALL",
        "hashed_embedding": "WITH k AS (SELECT p_partkey AS id, lower(p_name || '|' || p_brand || '|' || p_type) AS k FROM part), g AS (SELECT id, unnest(list_transform(range(1, greatest(length(k) - 2, 1) + 1), lambda i: substr(k, i, 3))) AS gram FROM k), h AS (SELECT id, ('0x' || substr(md5(gram), 1, 6))::BIGINT % 64 AS bucket, count(*) AS n FROM g GROUP BY ALL) SELECT id, bucket, n, round((n / sqrt(sum(n * n) OVER (PARTITION BY id)))::FLOAT::DOUBLE, 5) AS part FROM h",
        "l2_norm": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 2) AS v FROM embeddings) SELECT vec_id, unnest(range(len(v)))::INT AS pos, round((unnest(v) / sqrt(list_sum(list_transform(v, lambda x: x * x))))::FLOAT::DOUBLE, 5) AS value FROM e",
        "assign_partition": f"SELECT vec_id AS row_id, {_TREE} AS partition_id FROM embeddings",
        "spill_partitions": f"WITH {_SPILL} SELECT * FROM spilled",
        "partition_counts": f"SELECT {_TREE} AS partition_id, count(*) AS records FROM embeddings GROUP BY ALL",
        "spill_widths": f"WITH {_SPILL}, n AS (SELECT row_id, count(*) AS width FROM spilled GROUP BY row_id) SELECT width::INT AS width, count(*) AS records FROM n GROUP BY width",
        "distinct_partitions": f"SELECT count(DISTINCT {_TREE}) AS partitions FROM embeddings",
        "knn_cosine": f"WITH {_knn_cte()} SELECT src_id, dst_id, round(distance, 6) AS distance, rank FROM knn",
        "knn_sqeuclidean": f"WITH {_knn_cte(_SQUARED)} SELECT src_id, dst_id, round(distance, 6) AS distance, rank FROM knn",
        "knn_nonzero": f"WITH {_knn_cte(_SQUARED, 'distance > 0.000001')} SELECT src_id, dst_id, round(distance, 6) AS distance, rank FROM knn",
        "neighbors_model": f"WITH {_knn_cte()} SELECT src_id AS row_id, e.label, (rank - 1)::INT AS pos, dst_id AS neighbor, round(distance, 6) AS distance FROM knn JOIN e ON e.id = src_id",
        "neighbors_model_sqeuclidean": f"WITH {_knn_cte(_SQUARED, 'distance > 0.000001')} SELECT src_id AS row_id, e.label, (rank - 1)::INT AS pos, dst_id AS neighbor, round(distance, 6) AS distance FROM knn JOIN e ON e.id = src_id",
        "explode_pairs": f"WITH {_knn_cte()} SELECT src_id, dst_id, round(distance, 6) AS distance FROM knn",
        "enrich_pairs": f"WITH {_knn_cte()} SELECT src_id, dst_id, round(distance, 6) AS distance, l.label AS label_l, r.label AS label_r FROM knn LEFT JOIN e l ON l.id = src_id LEFT JOIN e r ON r.id = dst_id",
        "comparison_pairs": f"WITH {_knn_cte()} SELECT src_id, dst_id, round(distance, 6) AS distance, l.label AS label_l, l.id AS row_id_l, r.label AS label_r, r.id AS row_id_r FROM knn LEFT JOIN e l ON l.id = src_id LEFT JOIN e r ON r.id = dst_id WHERE distance <= {NEAR}",
        "distance_filter": f"WITH {_knn_cte()} SELECT src_id, dst_id, round(distance, 6) AS distance FROM knn WHERE distance <= {NEAR}",
        "clustering_filter": "SELECT src_id, dst_id, distance FROM candidate_pairs WHERE distance <= least(0.7::DOUBLE * 0.2::DOUBLE, 0.3) AND src_id IS NOT NULL AND dst_id IS NOT NULL",
        "lev_similarity": f"WITH {_scored_cte()} SELECT src_id, dst_id, {sims} FROM scored",
        "lev_missing_zero": f"WITH {_scored_cte('')} SELECT src_id, dst_id, {sims} FROM scored",
        "attribute_thresholds": f"WITH {_scored_cte()} SELECT src_id, dst_id FROM scored WHERE {_PASS}",
        "pass_rates": f"WITH {_scored_cte()} {rates}",
        "overall_similarity": f"WITH {_scored_cte()} SELECT src_id, dst_id, round(({' + '.join(f'{a}_sim * {w}::DOUBLE' for a, w in WEIGHTS.items())}) / {sum(WEIGHTS.values())}, 6) AS overall_similarity FROM scored",
        "similarity_stats": f"WITH {_scored_cte()} {stats}",
        "connected_components": f"WITH RECURSIVE {_near_cte()} SELECT node, component FROM comp",
        "components_candidate_pairs": f"WITH RECURSIVE near AS (SELECT DISTINCT src_id, dst_id FROM candidate_pairs WHERE src_id <> dst_id), {_components()} SELECT node, component FROM comp",
        "cluster_labels": f"WITH RECURSIVE {_labelled_cte()} SELECT row_id, label, cluster_id FROM labelled",
        "min_cluster_size": f"WITH RECURSIVE {_labelled_cte(3)} SELECT row_id, label, cluster_id FROM labelled",
        "cluster_sizes": f"WITH RECURSIVE {_labelled_cte()} SELECT cluster_id, size FROM sizes",
        "cluster_summary": f"WITH RECURSIVE {_labelled_cte()} SELECT sum(size)::BIGINT AS records, count(*) AS clusters, count(*) FILTER (size > 1) AS multi_clusters, coalesce(sum(size) FILTER (size > 1), 0)::BIGINT AS multi_records, max(size) AS largest FROM sizes",
        "distinct_clusters": f"WITH RECURSIVE {_labelled_cte()} SELECT count(*) AS clusters FROM sizes",
        "cluster_size_hist": _hist(f"RECURSIVE {_labelled_cte()}, src AS (SELECT size FROM sizes WHERE size > 1)", "size", "least(20, count(*))"),
        "distance_hist": _hist("src AS (SELECT distance FROM candidate_pairs)", "distance", "30"),
        "top_clusters": f"WITH RECURSIVE {_labelled_cte()}, top AS (SELECT * FROM sizes WHERE size > 1 ORDER BY size DESC, cluster_id LIMIT 10) SELECT cluster_id, label, row_id AS member, size FROM labelled JOIN top USING (cluster_id)",
        "neighbor_count": f"WITH {_knn_cte()} SELECT count(*) AS pairs FROM knn",
        "mean_distance": "SELECT round(avg(distance), 6) AS mean_distance FROM candidate_pairs",
        "compare_methods": f"""WITH RECURSIVE {_knn_cte()}, near AS (SELECT * FROM knn WHERE distance <= 0.65),
strict AS (SELECT n.* FROM near n JOIN e a ON a.id = src_id JOIN e b ON b.id = dst_id WHERE 1 - levenshtein(a.label::VARCHAR, b.label::VARCHAR)::DOUBLE / greatest(length(a.label::VARCHAR), length(b.label::VARCHAR)) >= 0.9),
{_components()}, {_components("strict", "_s")}, m AS (SELECT (SELECT count(DISTINCT component) FROM comp_s) AS multi_with, (SELECT count(DISTINCT component) FROM comp) AS multi_without)
SELECT multi_with, multi_without, multi_without - multi_with AS fewer FROM m""",
        "pipeline_e2e": _pipeline_sql(),
        "overview": "SELECT (SELECT count(*) FROM part) AS records, (SELECT count(*) FROM (DESCRIBE SELECT * FROM part)) AS columns",
        "column_ranges": " UNION ALL ".join(f"SELECT '{c}' AS column, count(DISTINCT {c}) AS distinct_values, min({c})::VARCHAR AS least, max({c})::VARCHAR AS greatest FROM wide_records" for c in ("year", "volume", "issue", "citation_count", "h_index")),
        "head_preview": "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 10",
        "stream_scoring": f"WITH s AS (SELECT a.p_partkey AS src_id, b.p_partkey AS dst_id, {part_lev('p_name')} AS n, {part_lev('p_type')} AS t FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size) SELECT src_id, dst_id, round(n, 6) AS p_name_sim, round(t, 6) AS p_type_sim FROM s WHERE n >= 0.5 AND t >= 0.3",
    }
