"""Every registered query against its SQL oracle on the smallest tables."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from oracle import connect, differences

import __spark_entry__ as contract
from millrace.queries import ORACLE, QUERIES, flows, registry

SF = "/root/testdata/sf0.001"
ROOT = Path(contract.__file__).resolve().parent

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= contract.queries().keys()


@pytest.mark.parametrize("left", ["nothing", "bytecode", "pipeline", "library"])
def test_entry_without_the_training_text_operators(tmp_path, left):
    """Their folders and the pipeline can be deleted, in part as well, and a library of theirs can be missing."""
    copy = tmp_path / "copy"
    gone = [] if left == "library" else ["llm", "__pycache__"]
    gone += [] if left in ("pipeline", "library") else ["corpus_pipeline.py"]
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", *gone))
    if left == "bytecode":
        (copy / "millrace/llm/__pycache__").mkdir(parents=True)
    code = "import sys; sys.modules['public_tokenizers'] = None\n" if left == "library" else ""
    code += "import __spark_entry__ as e; print(*sorted(e.queries()))"
    ran = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, check=True)
    assert ran.stdout.split() == sorted(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLE[name]) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() == 1000 and len(df.columns) == 72


def test_many_rows_of_a_directory_are_written_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(flows, "RAW_ROWS", 100)
    monkeypatch.setattr(registry, "_made", {})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        raw = flows.keyed_job_files(spark, SF)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = spark.read.json(raw)
    assert len(rows.inputFiles()) > 3
    assert rows.count() == rows.select("jsonBody.JOB_ID").distinct().count() == 1000
