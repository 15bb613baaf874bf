import os
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert len(q) >= 80 and set(o) <= set(q)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the synthetic tables")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    """A copy without those folders and the pipeline still imports and lists its queries."""
    import shutil

    shutil.copytree(f"{HERE}/tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{HERE}/__spark_entry__.py", tmp_path)
    code = """
import os, sys
import __spark_entry__ as e
q = e.queries()
assert not any(k.startswith("op") for k in q) and len(q) > 90 and len(e.oracle_sql()) > 90
if os.path.isdir("/root/testdata/sf0.001"):
    from pyspark.sql import SparkSession
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", sys.argv[1]).getOrCreate()
    assert q["strategy_fitness"](spark, "/root/testdata/sf0.001").count() > 3
assert not any(m.startswith("tidemark.llm") for m in sys.modules)
"""
    subprocess.run([sys.executable, "-c", code, str(tmp_path / "warehouse")], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
