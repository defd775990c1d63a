"""The registered queries: names, and a sample of them against their SQL."""

import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from vitrine.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not here")


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


def test_registry_without_the_training_data_operators(tmp_path):
    """A copy of the repository without them still imports and has all other queries."""
    root = Path(contract.__file__).parent
    shutil.copytree(root / "vitrine", tmp_path / "vitrine", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert found.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))], found.stderr


@needs_data
@pytest.mark.parametrize("name", ["check_inventory", "chunk_recursive", "vector_topk", "policy_tool", "gold_profile"])
def test_query_equals_sql(spark, name):
    frame = contract.queries()[name](spark, SF)
    con = duckdb.connect()
    for table in "part lineitem orders documents embeddings benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = con.execute(contract.oracle_sql()[name])
    columns = sorted(d[0] for d in cursor.description)
    order = [[d[0] for d in cursor.description].index(c) for c in columns]
    expected = Counter(tuple(row[i] for i in order) for row in cursor.fetchall())
    assert sorted(frame.columns) == columns
    assert Counter(tuple(r) for r in frame.select(*columns).collect()) == expected


@needs_data
def test_entry(spark):
    assert contract.entry(spark).count() == contract.queries()["intent_flags"](spark, SF).count()
