import importlib
import os
import sys

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def entry():
    return importlib.import_module("__spark_entry__")


def test_keys(entry):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p5_found"} <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_core_queries_equal_their_sql(spark, entry):
    import duckdb

    from seedloom.plans import catalog

    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    assert entry.entry(spark).count() > 0
    for name, sql in catalog.oracle_sql().items():
        df = catalog.queries()[name](spark, SF)
        cols = sorted(df.columns)
        rel = con.execute(sql)
        names = [x[0] for x in rel.description]
        assert sorted(names) == cols, name
        at = [names.index(c) for c in cols]
        want = sorted(repr([str(r[i]) for i in at]) for r in rel.fetchall())
        assert sorted(repr([str(x) for x in r]) for r in df.select(*cols).collect()) == want, name


def test_core_never_imports_llm():
    code = "import sys, seedloom.plans.catalog as c; c.queries(); sys.exit('seedloom.llm' in sys.modules)"
    assert os.spawnv(os.P_WAIT, sys.executable, [sys.executable, "-c", code]) == 0


def test_a_broken_subpackage_leaves_the_core():
    code = "import sys; sys.modules['seedloom.llm'] = None; import __spark_entry__ as e; sys.exit(not (e.queries() and e.oracle_sql() and 'p2_found' not in e.queries()))"
    assert os.spawnve(os.P_WAIT, sys.executable, [sys.executable, "-c", code], os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}) == 0
