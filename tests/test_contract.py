"""The driver's entry points, loaded by a process that has no Spark session."""

import os
import subprocess
import sys

import __spark_entry__ as contract

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_loads_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert df.columns == ["l_orderkey", "revenue", "o_orderdate"] and df.count() > 0
