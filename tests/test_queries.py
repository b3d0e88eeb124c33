"""Every query with SQL against DuckDB on the smallest tables; those without against brute force elsewhere."""

import math
import os

import pytest

from notelake import registry


def shown(row):
    return tuple("NULL" if v is None else str(round(v, 9)) if isinstance(v, float) and not math.isinf(v) else str(v) for v in row)


@pytest.fixture(scope="module")
def con(sf):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf, con, name):
    want = con.execute(registry.oracle_sql()[name]).fetchall()
    columns = [d[0] for d in con.description]
    df = registry.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(shown(r) for r in df.select(*columns).collect()) == sorted(shown(r) for r in want)


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"capped_links"}
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_works_without_the_training_data_subpackage():
    import subprocess
    import sys

    code = (
        "import sys\n"
        "class Absent:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('corpus_pipeline', 'notelake.llm'): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Absent())\n"
        "import __spark_entry__ as e\n"
        "assert 'fused_recall' in e.queries() and not any(q.startswith('op') for q in e.queries()) and 'pipeline' not in e.queries()\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
