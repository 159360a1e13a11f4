"""Every registered query that has SQL gives its rows, over whole tables."""

import importlib.util

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = entry.oracle_sql()


def near(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-9 * max(1, abs(a))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    other = con.sql(ORACLES[name])
    assert sorted(other.columns) == columns
    a = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    b = sorted(other.project(",".join(f'"{c}"' for c in columns)).fetchall(), key=repr)
    assert len(a) == len(b) > 0
    assert [(x, y) for x, y in zip(a, b, strict=True) if not all(map(near, x, y))][:3] == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert ("pipeline" in entry.queries()) == (importlib.util.find_spec("tamarack.llm") is not None)
