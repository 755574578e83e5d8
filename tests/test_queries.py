"""Every core query against its SQL on the smallest test data, and the rest of the package without the llm folder."""

import os
import subprocess
import sys

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def names():
    from strandloom.plans import annotation, importing, training

    return [(m, n) for m in (annotation, importing, training) for n in m.QUERIES]


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        path = f"{DATA}/{f}"
        c.execute(f"create view {f.removesuffix('.parquet')} as from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


@pytest.mark.parametrize("module,name", names(), ids=lambda x: x if isinstance(x, str) else "")
def test_query(spark, con, module, name):
    from compare import rows_of

    df = module.QUERIES[name](spark, DATA)
    got = rows_of(df.columns, df.collect())
    if name in module.SQL:
        cur = con.execute(module.SQL[name])
        cols = [c[0] for c in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert got == rows_of(cols, cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_llm(tmp_path):
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "strandloom"), tmp_path / "strandloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert e.llm is None and 'p1_found' in e.queries() and 'p7_ids' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""})
