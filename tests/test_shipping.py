"""Python workers find the package wherever the driver's program runs."""

import os
import subprocess
import sys

PROGRAM = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
import __spark_entry__ as entry
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("page_record", "page_navigation", "page_sanitised", "helper_clean_text", "vector_index_search"):
    print(name, entry.queries()[name](s, "/root/testdata/sf0.001").count() > 0)
"""


def test_queries_from_another_folder(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", PROGRAM, repo], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert [x for x in out.stdout.splitlines() if x.endswith(" True")].__len__() == 5, out.stderr[-2000:]
