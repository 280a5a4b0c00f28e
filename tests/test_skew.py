"""Half of all events belong to one player and slices are tiny: results still equal the SQL."""

import os

import duckdb
import pytest

from checks import bindings, registry
from checks.compare import norm
from lifelog.operators import ordered

SOURCE = "/root/testdata/sf0.001"
NAMES = ["players", "lives", "sessions", "kills", "life_hits", "qualified_at", "life_encounters", "player_priors",
         "played_seconds_at", "session_groups"]


@pytest.mark.skipif(not os.path.isdir(SOURCE), reason="driver tables not mounted")
def test_hot_player_over_many_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordered.event_slice, "__defaults__", ("event_id", 40))
    monkeypatch.setattr(ordered.time_slice, "__defaults__", (86_400,))
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT event_id, ts, CASE WHEN event_id % 2 = 0 THEN 3 ELSE user_id END AS user_id, event_type,
                    value, props FROM '{SOURCE}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name in ("orders", "customer", "documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SOURCE}/{name}.parquet'")
    bindings._WORLDS.clear()
    for name in NAMES:
        got = registry.QUERIES[name](spark, str(tmp_path)).toPandas()
        assert len(got) and norm(got) == norm(con.execute(registry.ORACLE[name]).fetchdf()), name
