"""The entry works from another folder, as a job's tasks have no copy of the repository beside them."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
JOB = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert entry.entry(spark).count() > 0
if entry.llm:
    assert entry.queries()["op9_benchmark_leaks"](spark, "/root/testdata/sf0.001").count() > 0
    assert entry.queries()["pipeline"](spark, "/root/testdata/sf0.001").count() > 0
assert entry.oracle_sql().keys() <= entry.queries().keys()
print("fine")
"""


def test_from_another_folder(tmp_path):
    done = subprocess.run([sys.executable, "-c", JOB.format(root=str(ROOT))], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)} | {k: v for k, v in __import__("os").environ.items() if k in ("PATH", "JAVA_HOME", "SPARK_HOME", "PYENV_ROOT")})
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]
