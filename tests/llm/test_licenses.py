import os

import duckdb
import pytest

from vitrine.llm import licenses as L

TEXTS = [
    "Licensed under the Apache License, Version 2.0. MIT License!",
    "GNU General Public License, version 3 and GNU general public license",
    "Released under CC BY-NC 4.0; cc. by; ccby",
    "license mit; general public gnu license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this thing",
    "mit license " * 40,
    None,
    "",
]


@pytest.mark.parametrize("frequency", [None, {}])
def test_equals_plain_search(spark, odd_rows, frequency):
    rows = [*enumerate(TEXTS), *[(100 + i, r[1]) for i, r in enumerate(odd_rows)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in L.scan(docs, frequency=frequency).drop("text").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, None if t is None else t.replace("\0", " ")) for i, t in rows])
    assert sorted(got) == sorted(con.execute(L.oracle()).fetchall())
    found = {r[0]: r for r in got}
    assert found[0][5] == "apache,mit" and found[1][2] == 2 and found[2][6] == "cc-by,cc-by-4.0,cc-by-nc,cc-by-nc-4.0".replace("cc-by-4.0,", "")
    assert found[3][2] == 0 and found[4][6] == "mit-text" and 0.5 < found[4][7] < 1 and found[5][2] == 40
    assert found[6][1:] == (0, 0, None, None, "", "", 0.0)


def test_no_python_in_the_plan(spark, odd_docs, clashing, no_docs):
    plan = L.scan(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert L.scan(clashing).count() == clashing.count() and L.scan(no_docs).count() == 0
