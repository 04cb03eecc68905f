"""Queries work where the workers cannot import the package by themselves."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from silkloom import ship
from silkloom.sources import files
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
ship(spark), ship(spark)
assert files.read_documents(spark, {folder!r}).first().text == "x"
"""


def test_package_is_sent(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("x")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT), folder=str(tmp_path / "in"))], cwd=tmp_path, env=env, check=True, timeout=200)
