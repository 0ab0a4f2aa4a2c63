"""The session stream: no Python per session, batches, late and odd events, a table of one file or of several."""

from datetime import datetime

import duckdb
import pytest

from tessera.operators import sessions as S
from tessera.queries import ORACLES
from tessera.streaming.sessions import run_sessions

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event(number, day, time, user, kind, value=20.0):
    return (number, datetime.fromisoformat(f"{day} {time}") if day else None, user, kind, value, "{}")


def test_no_python_per_session(spark, tmp_path):
    plan = S.session_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path)))._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "Pandas" not in plan and "Python" not in plan


def test_batches(spark, tmp_path):
    """A day's state outlives gaps of hours and takes late events in their order; it goes with a call of two days after."""
    batches = [
        [event(1, "2024-01-01", "08:00:00", 7, "view")],
        [event(2, "2024-01-01", "20:00:00", 7, "click")],
        [event(3, "2024-01-02", "01:00:00", 7, "view"), event(4, "2024-01-01", "12:00:00", 7, "purchase")],
        [event(5, "2024-01-03", "01:00:00", 7, "view")],
        [event(6, "2024-01-01", "21:00:00", 7, "view"), event(7, "2024-01-02", "02:00:00", 7, "view")],
    ]
    path, seen = str(tmp_path / "events"), []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = S.session_stream(spark.readStream.schema(SCHEMA).parquet(path))
        made = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda b, _: seen.append(sorted(map(tuple, b.collect()))))
        made.trigger(availableNow=True).start().awaitTermination()
    first, second, third = "7/2024-01-01", "7/2024-01-02", "7/2024-01-03"
    assert [x for x in seen if x] == [
        [(first, 1, 200, 1)],
        [(first, 2, 400, 2)],
        [(first, 3, 600, 1), (second, 1, 200, 1)],
        [(third, 1, 200, 1)],
        [(second, 2, 400, 2)],
    ]


@pytest.mark.parametrize("parts", [1, 3])
def test_odd_events_as_in_sql(spark, tmp_path, parts):
    rows = [
        event(1, "2024-01-01", "08:00:00", 1, "view"), event(1, "2024-01-01", "08:00:00", 1, "view"), event(None, "2024-01-01", "09:00:00", 1, "purchase"), event(3, "2024-01-01", "09:00:00", 1, "click"),
        event(4, "1969-12-31", "23:00:00", 1, "click"), event(5, "1970-01-01", "00:00:00", 1, "view", None), event(6, "2024-01-01", "10:00:00", None, "view"), event(7, None, None, 1, "view"), event(8, "2024-01-01", "23:59:59", 2, None), event(9, "2024-01-02", "00:00:00", 2, "signup"),
    ]
    path = str(tmp_path / "events.parquet")
    if parts == 1:
        spark.createDataFrame(rows, SCHEMA).toPandas().astype({"event_id": "Int64", "user_id": "Int64"}).to_parquet(path, index=False, coerce_timestamps="us")
    else:
        spark.createDataFrame(rows, SCHEMA).repartition(parts).write.parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{path}{'/*.parquet' if parts > 1 else ''}'")
    want = db.execute(ORACLES["stream_sessions"]).df()
    got = run_sessions(spark, path).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.to_numpy())) == sorted(map(tuple, want.to_numpy())) and len(want) == 5
