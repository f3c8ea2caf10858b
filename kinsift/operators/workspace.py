"""Intermediate tables in the folder that all executors share, and numbering without a single-task sort."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, else of the context. Only a local master, as in tests, gets a folder of its own where none is set."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        context_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = context_dir.get() if context_dir.isDefined() else None
    if not known:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="kinsift-shared-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def parallelism(spark: SparkSession) -> int:
    """Partitions for CPU-heavy stages: as many as the shuffle uses, at least one per core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone when the process ends
        pass


class Workspace:
    """Tables written to the shared folder to cut lineage. They survive lost executors; drop() deletes one early, the rest goes when the process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.count = spark, 0
        self.root = f"{shared_dir(spark)}/kinsift-{name}-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, self.root)

    def write(self, df: DataFrame) -> DataFrame:
        """df written as Parquet and read again."""
        self.count += 1
        path = f"{self.root}/{self.count:04d}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kinsift_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_kinsift_path", None)
        if path:
            _delete(self.spark, path)


def dense_index(df: DataFrame, *order: str | Column, name: str = "row_id", start: int | Column = 0) -> DataFrame:
    """df with positions 0, 1, ... in the given order: ranges are sorted apart, and their sizes (one row each) give the offsets."""
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    placed = Workspace(spark, "index").write(placed)  # ranges are drawn anew each time they are computed
    total, offsets = 0, []
    for r in placed.groupBy("_range").count().orderBy("_range").collect():  # as many rows as shuffle partitions
        offsets += [F.lit(r["_range"]), F.lit(total)]
        total += r["count"]
    offset = F.create_map(*offsets)[F.col("_range")] if offsets else F.lit(0)
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.withColumn(name, (within - 1 + offset + start).cast("long")).drop("_range")
