"""The driver contract: names, SQL against DuckDB on the smallest tables, and an import without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"evidence_rows", "findings_from_headers", "cwe_cve_lists", "review_summary", "review_tools"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def rounded(rows):
    return sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_query_equals_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    sql = con.sql(entry.oracle_sql()[name])
    assert columns == sorted(sql.columns)
    want = con.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    assert rounded(got) == rounded(want) and got


def test_works_without_the_corpus_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", ".pytest_cache"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    names = said.stdout.split()
    assert "severity_rollup" in names and not any(n.startswith("op") or n == "pipeline" for n in names)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
