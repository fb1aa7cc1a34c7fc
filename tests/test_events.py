"""Queries over events against their SQL on rows that the driver's tables lack."""

import datetime

import duckdb
import pytest

from helixframe.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Marks on both sides of 1970, with parts of a minute, a millisecond and without a time; every time of a user once."""
    folder = tmp_path_factory.mktemp("odd")
    at = datetime.datetime(1970, 1, 1) - datetime.timedelta(minutes=40)
    rows = [(u, at + datetime.timedelta(seconds=97 * i * (1 + u % 3) + u, microseconds=500 * (i % 2))) for u in range(9) for i in range(60)]
    rows += [(u, datetime.datetime(1969, 5, 1 + u, 3, 4, 5, 600 * u)) for u in range(20, 26)]
    rows += [(u, None) for u in (1, 2, 2, 30)] + [(None, at)]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (user_id BIGINT, ts TIMESTAMP)")
    con.executemany("INSERT INTO events VALUES (?, ?)", rows)
    con.execute(f"COPY events TO '{folder}/events.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["interval_merge_100", "mark_clumps", "misassembled_windows", "top3_limits", "densest_window", "interval_diff_100"])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_marks_before_1970_and_without_time(spark, odd, name, zone):
    folder, con = odd
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        want = con.execute(ORACLES[name])
        names = [c[0] for c in want.description]
        got = [tuple(r) for r in QUERIES[name](spark, str(folder)).select(*names).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert sorted(got, key=str) == sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("name", ["interval_merge_100", "mark_clumps", "misassembled_windows", "top3_limits", "densest_window", "interval_diff_100"])
def test_marks_just_before_a_minute(spark, tmp_path, name):
    """Parts of a millisecond count to the nearest: 59.9995 seconds are the next minute."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events (user_id BIGINT, ts TIMESTAMP)")
    for user, year in ((1, 2024), (2, 1969), (3, 1970)):
        at = datetime.datetime(year, 1, 1, 0, 0, 59)
        rows = [(user, at + datetime.timedelta(minutes=100 * i + i % 3, microseconds=999_000 + part)) for i, part in enumerate((0, 499, 500, 501, 999, 600, 499, 500))]
        con.executemany("INSERT INTO events VALUES (?, ?)", rows)
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*names).collect()]
    assert sorted(got) == sorted(want.fetchall())
