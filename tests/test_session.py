"""Code on executors and the shared folder."""

import os
import subprocess
import sys

import pytest

from querywarden import session


def test_queries_run_from_another_folder_without_a_path(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", {repo + "/__spark_entry__.py"!r})
entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
for name in ("mapper_statement_extract", "batch_score", "vector_topk"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="must name a folder"):
        session.scratch_root(Session())


def test_scratch_is_removed(spark):
    stored = session.cut_lineage(spark.range(5), "gone")
    path = stored.inputFiles()[0].removeprefix("file:").rpartition("/")[0].replace("//", "/")
    assert os.path.isdir(path)
    others, session._made[:] = session._made[:-1], session._made[-1:]
    assert session.clear_scratch(spark) == 1 and not os.path.isdir(path)
    session._made[:] = others
