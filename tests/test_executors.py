"""Executors need no copy of the package on their path."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
sys.path.insert(0, {repo!r})  # the driver's path only
import random
from kinsift.operators import neighbors, partitioning

def away(batches):
    try:
        import kinsift
    except ImportError:
        yield from batches

assert spark.range(4).mapInArrow(away, "id long").count() == 4
r = random.Random(1)
v = spark.createDataFrame([(k, [r.random() for _ in range(4)]) for k in range(200)], "row_id long, normFeatures array<float>")
tree = partitioning.learn_tree(v, max_tree_depth=4, min_leaf_size=4)
assert partitioning.leaf_count(tree) == 16
assert neighbors.approx_knn(v, tree, 3).count() == 600 and neighbors.centroid_knn(v, 3, cell_rows=20).count() > 500
print("fine")
"""


def run_away(code: str) -> str:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code.format(repo=REPO)], cwd="/", env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout


def test_searches_run_without_the_package_on_executors():
    assert "fine" in run_away(CODE)
