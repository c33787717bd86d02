import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from crawlloom.plans import catalogue

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_works_without_the_optional_part(tmp_path):
    """A copy without its folders and file imports and registers the other queries."""
    for name in ("__spark_entry__.py", "crawlloom"):
        source, target = ROOT / name, tmp_path / name
        shutil.copytree(source, target, ignore=shutil.ignore_patterns("__pycache__", "llm")) if source.is_dir() else shutil.copy(source, target)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    queries, sql = (set(x.split()) for x in said.stdout.splitlines())
    assert queries == set(catalogue.queries()) and sql == set(catalogue.oracle_sql())


def test_every_query_has_its_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_nothing_imports_the_optional_part():
    for path in (ROOT / "crawlloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path


def test_entry(spark):
    assert set(__spark_entry__.entry(spark).columns) == {"page_id", "ord", "link"}


def rows(columns, values):
    return sorted(tuple(str(v) for _, v in sorted(zip(columns, r, strict=True))) for r in values)


@pytest.mark.parametrize("name", catalogue.queries())
def test_queries_agree_with_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.sql(catalogue.oracle_sql()[name])
    got = catalogue.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
