import importlib.util
import os

import pytest

import __spark_entry__ as entry
from orrery.plans import registry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")
    df = registry.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else float(v) if type(v).__name__ == "Decimal" else v
    got = sorted([tuple(str(plain(r[c])) for c in columns) for r in df.collect()])
    cur = con.execute(registry.ORACLES[name])
    at = [d[0] for d in cur.description]
    assert sorted(at) == columns
    want = sorted([tuple(str(plain(r[at.index(c)])) for c in columns) for r in cur.fetchall()])
    assert got == want


def test_core_needs_no_subpackage():
    root = os.path.dirname(importlib.util.find_spec("orrery").origin)
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert "orrery.llm" not in open(os.path.join(folder, f), encoding="utf8").read()
