"""Executors need no copy of the package on their path."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
sys.path.insert(0, {repo!r})  # the driver's path only
from kinsift.llm.components import connected_components
from kinsift.llm.contamination import leaked_items
from kinsift.llm.tokenize import encode_corpus

def away(batches):
    try:
        import kinsift
    except ImportError:
        yield from batches

assert spark.range(4).mapInArrow(away, "id long").count() == 4
passage = "The miller of the valley counted forty copper kettles beneath the old bridge."
documents = spark.createDataFrame([(1, "First. " + passage), (2, "nothing here"), (3, None)], "doc_id long, text string")
items = spark.createDataFrame([(7, passage)], "item_id int, passage string")
assert [tuple(r) for r in leaked_items(documents, items).collect()] == [(1, 7)]
assert encode_corpus(documents).count() == 3
assert connected_components(spark.createDataFrame([(1, 2), (2, 3)], "src_id long, dst_id long")).count() == 3
print("fine")
"""


def test_operators_run_without_the_package_on_executors():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=REPO)], cwd="/", env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "fine" in done.stdout, done.stderr[-3000:]
