import importlib.util
import sys

import pytest

import __spark_entry__ as entry
from vellum.plans import catalogue


def test_every_query_of_the_core_has_a_callable_and_sql_belongs_to_a_query():
    q, s = catalogue.queries(), catalogue.oracle_sql()
    assert len(q) > 70 and set(s) <= set(q) and catalogue.FLAGSHIP in q
    assert set(q) <= set(entry.queries())


def test_core_does_not_import_the_optional_package():
    code = "import sys\nfrom vellum.plans import catalogue\ncatalogue.queries()\nprint([m for m in sys.modules if m.startswith('vellum.llm')])"
    import subprocess

    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, check=True)
    assert out.stdout.strip() == "[]"


@pytest.mark.skipif(importlib.util.find_spec("duckdb") is None, reason="no duckdb")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_results_equal_sql(spark, name):
    import os

    import duckdb

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for f in os.listdir(d):
        con.sql(f"create view {f.split('.')[0]} as select * from '{d}/{f}'")
    df = catalogue.queries()[name](spark, d)
    cols = sorted(df.columns)
    rel = con.sql(catalogue.oracle_sql()[name])
    ix = [list(rel.columns).index(c) for c in cols]
    r6 = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted((tuple(r6(r[c]) for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r6(r[i]) for i in ix) for r in rel.fetchall()), key=repr)
