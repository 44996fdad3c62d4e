"""The library without its optional parts, and without preset folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def run(code: str, cwd: Path, **env: str) -> str:
    out = subprocess.run([sys.executable, "-c", code], cwd=cwd, env=os.environ | {"PYTHONPATH": str(cwd)} | env, capture_output=True, text=True, timeout=240)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout.strip().splitlines()[-1]


@pytest.mark.parametrize("gone", [["tallywire/llm", "tests/llm"], ["tallywire/llm", "tests/llm", "corpus_pipeline.py"]])
def test_imports_without_optional_parts(tmp_path, gone):
    copy = tmp_path / "copy"
    names = [*gone, ".git"]
    shutil.copytree(REPO, copy, ignore=lambda d, found: [n for n in found if str((Path(d) / n).relative_to(REPO)) in names or n == "__pycache__"])
    code = "import __spark_entry__ as e; from tallywire.checks.base import QUERIES, ORACLES; assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLES); print(len(e.queries()))"
    assert int(run(code, copy)) >= 126


def test_shared_folder_where_none_is_set(tmp_path):
    code = f"""
from tallywire.session import local_session, checkpoint_root
import __spark_entry__ as e
spark = local_session(2)
assert checkpoint_root(spark) == checkpoint_root(spark)
print(e.queries()["scan_frames"](spark, "{SF}").count())
"""
    (tmp_path / "conf").mkdir()
    assert int(run(code, REPO, SPARK_CONF_DIR=str(tmp_path / "conf"))) > 0


def test_shared_folder_as_set(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
from tallywire.session import checkpoint_root
spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", "{tmp_path}/shared").config("spark.ui.enabled", "false").getOrCreate()
print(checkpoint_root(spark))
"""
    assert run(code, REPO) == f"{tmp_path}/shared"
