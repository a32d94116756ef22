"""Each query against its SQL, as the driver compares them, on the smallest tables; and the others' shape."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from orderweave.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 6) + 0.0 if isinstance(value, float) else value if isinstance(value, (int, bool, str)) else str(value)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    relation = duck.sql(catalogue.SQL[name])
    assert sorted(relation.columns) == names
    key = lambda r: tuple((v is None, str(type(v)), v) for v in r)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=key)
    order = [relation.columns.index(c) for c in names]
    theirs = sorted((tuple(plain(r[k]) for k in order) for r in relation.fetchall()), key=key)
    assert ours == theirs and ours


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_others_run(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_entry_imports_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    repo = Path(__file__).resolve().parent.parent
    shutil.copytree(repo / "orderweave", tmp_path / "orderweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:{':'.join(p for p in sys.path if 'site-packages' in p)}"})
    assert said.returncode == 0, said.stderr
    assert said.stdout.split() == [str(len(catalogue.QUERIES)), str(len(catalogue.SQL))]
