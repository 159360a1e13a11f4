"""Events without a user or a type keep their rows, as in the SQL."""

import duckdb
import pandas as pd
import pytest
from test_oracles import ORACLES, SMALL, near

import __spark_entry__ as entry


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n.startswith("feature_") or n == "payload_json_roundtrip"))
def test_null_users_and_types(spark, tmp_path, name):
    e = pd.read_parquet(f"{SMALL}/events.parquet").astype({"user_id": "Int64"})
    e.loc[e["event_id"] % 7 == 0, "user_id"] = None
    e.loc[e["event_id"] % 5 == 0, "event_type"] = None
    e["ts"] = e["ts"].astype("datetime64[us]")
    e.to_parquet(tmp_path / "events.parquet", index=False)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    a = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    b = sorted(con.sql(ORACLES[name]).project(",".join(f'"{c}"' for c in columns)).fetchall(), key=repr)
    assert len(a) == len(b) > 0
    assert [(x, y) for x, y in zip(a, b, strict=True) if not all(map(near, x, y))][:3] == []
