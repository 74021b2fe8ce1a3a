from __future__ import annotations

import os
import re
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as spark_entry
from keyloom import queries as engine_queries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"

WITHOUT = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name in GONE or name.startswith("keyloom.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
GONE = {gone!r}
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
print(sorted(e.queries()) == sorted(e._engine.QUERIES), all(k in e.queries() for k in e.oracle_sql()))
"""


@pytest.mark.parametrize("gone", [["corpus_pipeline"], ["keyloom.llm"], []])
def test_entry_without_the_training_data_parts(gone):
    out = subprocess.run([sys.executable, "-c", WITHOUT.replace("{gone!r}", repr(gone))], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["True", "True"], out.stderr


def test_nothing_else_imports_the_training_data_parts():
    for folder, _, names in os.walk(os.path.join(ROOT, "keyloom")):
        if f"{os.sep}llm" in folder:
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert not re.search(r"\bllm\b", f.read()), name


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(engine_queries.QUERIES))
def test_query_matches_its_sql(spark, name):
    got = engine_queries.QUERIES[name](spark, SMALL).toPandas()
    assert len(got)
    if name not in spark_entry.oracle_sql():
        return
    con = duckdb.connect()
    for table in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{table}'")
    expected = con.sql(spark_entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    order = lambda d: sorted(map(str, d[columns].astype(object).itertuples(index=False, name=None)))
    assert order(got) == order(expected)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
def test_flagship_plan_filters_at_the_scan(spark):
    plan = spark_entry.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,10.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint" in plan and "l_shipdate" not in plan
