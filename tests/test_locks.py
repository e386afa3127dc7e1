"""Lock queries on requests at fractions of a second, side by side with their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

#: Ends of locks that come out otherwise if seconds are cut, or halves always rounded up.
EVENTS = [(1, "00:00:10.6", 1, "click"), (2, "00:10:10.2", 51, "click"), (3, "00:10:20.9", 101, "view"), (4, "00:00:00.5", 2, "click"), (5, "00:10:00.4", 52, "click"), (6, "00:00:02.5", 3, "click"), (7, "00:10:01.5", 53, "view"), (8, "00:10:02.5", 53, "view"), (9, "00:10:11.7", 51, "purchase"), (10, "00:10:12.2", 151, "view"), (11, "00:20:00.0", 4, "view"), (12, "00:20:00.9", 4, "purchase")]


@pytest.mark.parametrize("name", ["lock_replay", "active_locks"])
def test_seconds_are_rounded_as_in_sql(spark, tmp_path, name):
    db = duckdb.connect()
    rows = ", ".join(f"({i}::BIGINT, TIMESTAMP '2024-01-01 {ts}', {user}::BIGINT, '{kind}', 0.0::DOUBLE)" for i, ts, user, kind in EVENTS)
    db.execute(f"CREATE TABLE events AS SELECT * FROM (VALUES {rows}) AS e(event_id, ts, user_id, event_type, value)")
    db.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = entry.queries()[name](spark, str(tmp_path))
    want = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in columns)) for r in got.collect())
