"""Shared helpers: folders, bounds of broadcasts, free column names."""

import os
import subprocess
import sys

import pytest

from heliotrope.llm import _shared

PROBE = """
from pyspark.sql import SparkSession
from heliotrope.llm._shared import work_dir
class Context:
    master = "spark://far:7077"
    def getCheckpointDir(self):
        return None
class Conf:
    def get(self, key, default=None):
        return default
class Session:
    sparkContext, conf = Context(), Conf()
try:
    work_dir(Session(), "x")
except RuntimeError as e:
    print("refused", e)
"""


def test_no_folder_of_the_driver_on_a_cluster():
    got = subprocess.run([sys.executable, "-c", PROBE], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": os.getcwd()})
    assert got.stdout.startswith("refused"), got.stderr


def test_bounded(spark):
    df = spark.createDataFrame([(i, "x" * 1000) for i in range(10)], "a long, b string")
    assert _shared.bounded(df, 10, 20_000) and not _shared.bounded(df, 9, 20_000) and not _shared.bounded(df, 10, 9_000)
    with pytest.raises(ValueError):
        _shared.bounded(spark.sql("select array(1) as a"), 10, 10)
    assert _shared.freed(df, "A", "c").columns == ["a_", "b"]


def test_scratch_tables_go(spark, tmp_path):
    with _shared.scratch(spark):
        made = _shared.written(spark.range(3), "test-scratch")
        with _shared.scratch(spark):
            inner = _shared.written(made, "test-inner")
        assert made.count() == 3
        with pytest.raises(Exception, match="(?i)exist"):
            inner.count()
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(made._heliotrope_path)
