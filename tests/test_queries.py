"""Every query with SQL gives the rows of that SQL over the smallest tables."""

import math
import os

import duckdb
import pytest
from testpaths import SMALL

from gaugeframe import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in TABLES:
        f = f"{SMALL}/{n}.parquet"
        c.execute(f"create view {n} as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    rows = sorted(repr([norm(r[c]) for c in columns]) for r in df.collect())
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    got = duck.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == columns
    assert sorted(repr([norm(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in got.fetchall()) == rows


def test_interval_join_between_whole_seconds(spark, duck, tmp_path):
    """Events a part of a second from the ends of a span, before 1970 too: seconds are the nearest ones, not the ones before."""
    path = tmp_path / "events.parquet"
    ends = "(1, '2024-01-01 00:00:10.4', 'purchase'), (1, '2024-01-01 00:00:20.4', 'purchase'), (3, '1969-12-31 23:59:50.5', 'purchase'), (3, '2024-01-01 00:00:20.5', 'purchase'), (4, '2024-01-01 00:00:20', 'purchase')"
    near = ", ".join(f"({u}, '{x}', 'view')" for u, x in [(1, "2024-01-01 00:00:09.6"), (1, "2024-01-01 00:00:09.4"), (4, "2024-01-01 00:00:20.6"), (1, "2024-01-01 00:00:20.5"), (3, "1969-12-31 23:59:49.6"), (3, "1969-12-31 23:59:49.4"), (2, "2024-01-01 00:00:15")])
    c = duckdb.connect()
    c.execute(f"copy (select u::BIGINT as user_id, t::TIMESTAMP as ts, e as event_type from (values {ends}, {near}) v(u, t, e)) to '{path}' (format parquet)")
    c.execute(f"create view events as select * from '{path}'")
    want = sorted(c.execute(registry.ORACLE_SQL["interval_join"]).fetchall())
    assert sorted((r["user_id"], r["n"]) for r in registry.QUERIES["interval_join"](spark, str(tmp_path)).collect()) == want == [(1, 4), (3, 3), (4, 1)]


def test_entry_without_llm():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
