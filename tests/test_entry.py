"""Every query of the core against its SQL at the smallest scale, and the library without the llm subpackage."""

import glob
import math
import os
import subprocess
import sys
from decimal import Decimal

import duckdb
import pytest

from ledgerloom.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, Decimal):
        return str(v.normalize())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_like_sql(spark, data, duck, name):
    df = registry.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(registry.oracle_sql()[name])
    at = [list(rel.columns).index(c) for c in columns]
    assert sorted(rel.columns) == columns
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def test_core_alone():
    code = "import sys; sys.modules['ledgerloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and 'p6_ids' not in q and 'p4_found' in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": ROOT})
