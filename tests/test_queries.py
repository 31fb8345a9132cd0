"""Every query with a SQL statement is held against DuckDB on the smallest tables."""

from __future__ import annotations

import json
import math

import duckdb
import numpy as np
import pytest

from chatterlake import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {str(k): plain(x) for k, x in v.items()}
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    return round(float(v), 9) if isinstance(v, (float, np.floating)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    frame = catalog.QUERIES[name](spark, FOLDER)
    rows = [r.asDict() for r in frame.collect()]
    if name not in catalog.ORACLE_SQL:
        assert len(rows) > 0
        return
    found = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    wanted = [dict(zip(columns, r, strict=True)) for r in found.fetchall()]
    assert sorted(columns) == sorted(frame.columns)
    line = lambda r: json.dumps([plain(r[c]) for c in sorted(columns)], ensure_ascii=False)
    assert sorted(map(line, rows)) == sorted(map(line, wanted))


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_keyword_confidence_has_every_user(spark, duck):
    users = {u for (u,) in duck.execute("SELECT DISTINCT user_id FROM events").fetchall()}
    assert {r.mention_id for r in catalog.QUERIES["keyword_confidence"](spark, FOLDER).collect()} == users
