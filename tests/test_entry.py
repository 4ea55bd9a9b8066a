import ast
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.ml.feature import StopWordsRemover

import __spark_entry__ as entry
from socialspark.constants import STOP_WORDS_ENGLISH

ROOT = Path(__file__).parent.parent
#: Iterative results that SQL has no words for; brute force checks them elsewhere.
WITHOUT_SQL = {"density_clusters"}
TABLES = "/root/testdata/sf0.001"


def test_sql_needs_no_session_and_covers_every_query(monkeypatch):
    monkeypatch.setattr("pyspark.__file__", "/nowhere/pyspark/__init__.py")
    sql = entry.library_sql()
    assert set(entry.library_queries()) - set(sql) == WITHOUT_SQL
    assert set(sql) <= set(entry.library_queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stop_words_are_those_of_spark(spark):
    assert STOP_WORDS_ENGLISH == StopWordsRemover.loadDefaultStopWords("english")


def test_the_library_stands_without_the_training_operators(tmp_path):
    for name in ("__spark_entry__.py", "socialspark"):
        os.symlink(ROOT / name, tmp_path / name) if name.endswith(".py") else None
    package = tmp_path / "socialspark"
    package.mkdir()
    for part in (ROOT / "socialspark").iterdir():
        if part.name != "llm":
            os.symlink(part, package / part.name)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    done = subprocess.run(
        [sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))"],
        cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=120,
    )
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(entry.library_queries())), "False", str(len(entry.library_sql()))]


def test_nothing_imports_the_training_operators():
    for file in (ROOT / "socialspark").rglob("*.py"):
        if "llm" in file.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(file.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in name for name in names), file


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables at hand")
def test_some_queries_against_their_sql(spark):
    import duckdb

    db = duckdb.connect()
    for file in os.listdir(TABLES):
        db.execute(f"create view {file.split('.')[0]} as select * from '{TABLES}/{file}'")
    sql, queries = entry.oracle_sql(), entry.queries()
    for name in ("month_share", "schema_groups", "top_words_overall", "embed_months"):
        got = queries[name](spark, TABLES).toPandas()
        want = db.execute(sql[name]).df()[list(got.columns)]
        assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None))), name
