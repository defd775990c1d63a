"""Compare registered queries with their SQL on one data set.

Usage: python tools/check_oracles.py SF_DIR [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from vitrine.plans import ORACLES, QUERIES  # noqa: E402
from vitrine.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def kind(name: str) -> str:
    name = name.lower()
    for prefix, family in (("big", "int"), ("int", "int"), ("hugeint", "hugeint"), ("double", "float"),
                           ("float", "float"), ("decimal", "decimal"), ("varchar", "str"), ("string", "str"),
                           ("bool", "bool")):
        if name.startswith(prefix):
            return family
    return name


def main() -> int:
    sf_dir, wanted = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    failures = 0
    for name in wanted:
        begin = time.time()
        try:
            frame = QUERIES[name](spark, sf_dir)
            got = [tuple(r) for r in frame.collect()]
        except Exception as error:  # noqa: BLE001 - report and go on
            print(f"{name:24s} SPARK ERROR {str(error)[:600]}", flush=True)
            failures += 1
            continue
        spark_time = time.time() - begin
        if name not in ORACLES:
            print(f"{name:24s} rows only  {len(got):8d} rows {spark_time:6.2f}s", flush=True)
            continue
        begin = time.time()
        try:
            cursor = con.execute(ORACLES[name])
            names = [d[0] for d in cursor.description]
            types = {d[0]: kind(str(d[1])) for d in cursor.description}
            expected = cursor.fetchall()
        except Exception as error:  # noqa: BLE001
            print(f"{name:24s} SQL ERROR {str(error)[:600]}", flush=True)
            failures += 1
            continue
        sql_time = time.time() - begin
        mine = {f: kind(t) for f, t in frame.dtypes}
        a, b = rows_of(frame.columns, got), rows_of(names, expected)
        same = a == b and mine == types
        failures += not same
        verdict = "equal" if same else "DIFFERENT"
        print(f"{name:24s} {verdict:10s} {len(got):8d} / {len(expected):8d} rows "
              f"{spark_time:6.2f}s / {sql_time:6.2f}s", flush=True)
        if not same:
            print("   types", {k: (mine.get(k), types.get(k)) for k in {*mine, *types} if mine.get(k) != types.get(k)})
            print("   only spark", list((a - b).elements())[:2])
            print("   only sql  ", list((b - a).elements())[:2])
    print("failures:", failures)
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
