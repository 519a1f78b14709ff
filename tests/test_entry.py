"""The registry stands with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import __spark_entry__ as e
names, sql = e.queries(), e.oracle_sql()
assert "hotspots" in names and set(sql) <= set(names), names
assert not [n for n in names if n.startswith("op") or n == "pipeline"], names
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
assert e.entry(spark).columns
"""


def copy_without(folder: Path, *gone: str) -> Path:
    copy = folder / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda path, names: [n for n in names if n in (".git", "__pycache__", ".pytest_cache") or str((Path(path) / n).relative_to(ROOT)) in gone])
    return copy


def test_stands_without_the_training_data_operators(tmp_path):
    for i, gone in enumerate((("codeloom/llm", "tests/llm"), ("codeloom/llm", "tests/llm", "corpus_pipeline.py"))):
        copy = copy_without(tmp_path / str(i), *gone)
        subprocess.run([sys.executable, "-c", CODE], cwd=copy, check=True, timeout=300)


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
