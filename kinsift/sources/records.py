"""Reading and writing record tables, row ids, feature detection, sample and synthetic records."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsift.operators.workspace import dense_index


def _is_parquet(spark: SparkSession, path: str) -> bool:
    """By the ends of the names: of the path, or of the data files in a directory."""
    if path.endswith(".parquet"):
        return True
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not system.getFileStatus(target).isDirectory():
            return False
        names = [str(f.getPath().getName()) for f in system.listStatus(target)]
    except Exception:  # a pattern of names has no status of its own
        return False
    return any(n.endswith(".parquet") for n in names)


def load_records(spark: SparkSession, path: str, schema=None, null_values: tuple[str, ...] = ("NA", "None", "NaN", "nan", "N/A", "null")) -> DataFrame:
    """CSV with header (types inferred unless a schema is given) or Parquet; a file or a directory of files, such as save_records writes. Raises FileNotFoundError for a missing local path."""
    local = path.removeprefix("file://")
    if "://" not in local and not os.path.exists(local):
        raise FileNotFoundError(path)
    if _is_parquet(spark, path):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    return df.select(*[F.when(~F.col(f"`{c}`").isin(*null_values), F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`") for c in df.columns])


def save_records(df: DataFrame | None, path: str, single_file: bool = False) -> None:
    """CSV with header, or Parquet by the name's end; single_file is for small results."""
    if df is None:
        raise ValueError("nothing to save: run the pipeline first")
    out = df.coalesce(1) if single_file else df
    if path.endswith(".parquet"):
        out.write.mode("overwrite").parquet(path)
    else:
        out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def detect_features(df: DataFrame) -> list[str]:
    """All columns whose name doesn't end in id, in order; row_id is not there yet or falls out too."""
    return [c for c in df.columns if not c.lower().endswith("id")]


def assign_row_id(df: DataFrame, *order: str) -> DataFrame:
    """Dense 0-based row_id in the order of the given columns, else of the rows' positions in their files (by name); an existing row_id is replaced."""
    plain = df.drop("row_id")
    if order:
        return dense_index(plain, *[F.col(f"`{c}`") for c in order])
    try:
        placed = plain.withColumn("_file", F.col("_metadata.file_path")).withColumn("_start", F.col("_metadata.file_block_start"))
        placed.schema  # resolved here, if at all
    except AnalysisException:  # no scan of files: the order of partitions is all there is
        placed = plain.withColumn("_file", F.lit("")).withColumn("_start", F.lit(0))
    placed = placed.withColumn("_place", F.monotonically_increasing_id())
    return dense_index(placed, "_file", "_start", "_place").drop("_file", "_start", "_place")


#: Fixed values of the minimal sample: titles and authors for five records each, venues for ten.
SAMPLE_TITLES = ("Deep Learning", "Machine Learning", "Neural Networks", "AI Research")
SAMPLE_AUTHORS = ("John Smith", "Jane Doe", "Bob Johnson", "Alice Brown")
SAMPLE_VENUES = ("NIPS", "ICML")


def minimal_sample(spark: SparkSession) -> DataFrame:
    """Twenty records: id, title, authors, venue, year."""
    block = lambda values, of: F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("n") / of) + 1).cast("int"))
    return spark.range(20).withColumnRenamed("id", "n").select(F.concat(F.lit("id_"), "n").alias("id"), block(SAMPLE_TITLES, 5).alias("title"), block(SAMPLE_AUTHORS, 5).alias("authors"), block(SAMPLE_VENUES, 10).alias("venue"), F.lit(2020).alias("year"))


def _pick(values: list[str], *salt: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(*salt), F.lit(len(values))) + 1).cast("int"))


def synthetic_records(spark: SparkSession, records: int = 300, works: int = 100, seed: int = 42) -> DataFrame:
    """Works with two to four noisy copies each, cut at the number of records; 24 columns. The same seed gives the same rows."""
    topics = ["entity matching", "graph search", "image retrieval", "speech tagging", "query planning", "text ranking", "record linkage", "stream sampling"]
    given, family = ["Ada", "Ben", "Cara", "Dan", "Eva", "Finn", "Gina", "Hugo"], ["Adler", "Brook", "Castle", "Dale", "Ember", "Field", "Grove", "Hill"]
    w, c, s = F.col("work"), F.col("copy"), F.lit(seed)
    copies = spark.range(works).withColumnRenamed("id", "work").withColumn("copy", F.explode(F.sequence(F.lit(0), (F.pmod(F.xxhash64(w, s), F.lit(3)) + 1).cast("int"))))
    title = F.concat_ws(" ", _pick(["A study of", "Scalable", "Robust", "Towards"], w, s, F.lit(1)), _pick(topics, w, s, F.lit(2)), F.concat(F.lit("no. "), w))
    g, f = _pick(given, w, s, F.lit(3)), _pick(family, w, s, F.lit(4))
    number = lambda low, high, salt: (F.pmod(F.xxhash64(w, c, s, F.lit(salt)), F.lit(high - low + 1)) + low).cast("int")
    df = copies.select(
        "work", "copy",
        F.when(c % 3 == 1, F.lower(title)).when(c % 3 == 2, F.concat(title, F.lit(" (extended)"))).otherwise(title).alias("title"),
        F.when(c % 2 == 1, F.concat(F.substring(g, 1, 1), F.lit(". "), f)).otherwise(F.concat_ws(" ", g, f)).alias("authors"),
        _pick(["ICDE", "VLDB", "SIGMOD", "KDD", "EDBT"], w, s, F.lit(5)).alias("venue"), (number(0, 0, 6) + 2000 + (w % 24)).cast("int").alias("year"), number(1, 40, 7).alias("volume"), number(1, 12, 8).alias("issue"),
        F.concat(number(1, 400, 9), F.lit("-"), number(401, 800, 10)).alias("pages"), F.when(c % 4 == 3, F.lit("")).otherwise(F.concat(F.lit("10.1000/"), w)).alias("doi"), F.concat(F.lit("978-"), number(1000, 9999, 11)).alias("isbn"),
        _pick(["North Press", "South Press"], w, s, F.lit(12)).alias("publisher"), _pick(["First University", "Second Institute"], w, s, F.lit(13)).alias("institution"), _pick(["Norway", "Chile", "Ghana"], w, s, F.lit(14)).alias("country"), F.lit("English").alias("language"),
        _pick(topics, w, s, F.lit(15)).alias("keywords"), F.concat(F.lit("We study "), _pick(topics, w, s, F.lit(2)), F.lit(".")).alias("abstract"), _pick(["none", "Open Fund"], w, s, F.lit(16)).alias("funding"), _pick(["online", "hybrid", "on site"], w, s, F.lit(17)).alias("conference_type"),
        number(0, 500, 18).alias("citation_count"), number(1, 90, 19).alias("h_index"), (number(10, 900, 20) / 100.0).alias("impact_factor"), (number(0, 1, 21) == 1).alias("open_access"), (number(0, 9, 22) > 0).alias("peer_reviewed"),
    )
    # a file needs just so many rows: works are cut in order, and works of their own fill up
    numbered = dense_index(df, "work", "copy", name="n").where(F.col("n") < records)
    have = numbered.count()
    if have < records:
        extra = synthetic_records(spark, records - have, max(records - have, 1), seed + 1).drop("id", "row_id")
        numbered = numbered.drop("n", "work", "copy").unionByName(extra)
        numbered = dense_index(numbered, "title", "authors", "pages", name="n")
    columns = [x for x in numbered.columns if x not in ("n", "work", "copy")]
    return numbered.select((F.col("n") + 1).cast("int").alias("id"), (F.col("n") + 1).cast("int").alias("row_id"), *columns)
