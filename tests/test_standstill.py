"""Standstills, divisions by zero and sums whose last bits differ: queries and their SQL state one rule."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as registry
from lapframe.operators import distance, laps


def _map(spark):
    speed = spark.createDataFrame([(1, 0.0, 0.0), (1, 20_000.0, 0.0), (1, 30_000.0, 10.0), (1, 40_000.0, 0.0), (1, 60_000.0, 0.0)], "session_id long, tc double, value double")
    lap = spark.createDataFrame([(1, 0, 0.0, 60_000.0)], "session_id long, lap_num int, start_tc double, end_tc double")
    return distance.build_dist_map(speed, lap, 1000.0).cache()


def test_a_standstill_ends_at_its_last_grid_point(spark):
    m = _map(spark)
    at = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 1e-9), (1, 100.0), (1, 100.0 - 1e-9)], "session_id long, dist double")
    got = {r.dist: r.tc for r in distance.dist_to_time(at, m, 1000.0).collect()}
    assert (got[0.0], got[1e-9]) == (pytest.approx(20_000.0), pytest.approx(20_000.0))
    assert got[1.0] == pytest.approx(21_000.0)
    assert got[100.0] == got[100.0 - 1e-9] == 59_000.0


def test_slip_and_places_of_a_lap_that_stands_still(spark):
    m = _map(spark)
    # Lengths of nothing that come out below zero, as sums taken in another order may.
    lap = spark.createDataFrame([(1, 0, 0.0, 10_000.0, 0.0, -1e-13), (1, 1, 10_000.0, 60_000.0, 0.0, 100.0)], "session_id long, lap_num int, start_tc double, end_tc double, start_dist double, end_dist double")
    slip = {r.lap_num: (r.rel, r.slip_s) for r in distance.time_slip(lap, lap.filter("lap_num = 0"), m, 50.0, 1000.0).collect()}
    assert slip == {0: (0.0, None), 1: (0.0, pytest.approx(-10.0))}
    v = spark.createDataFrame([(1, "v", 0.0, 0.0), (1, "v", 60_000.0, 60.0)], "session_id long, channel string, tc double, value double")
    even = distance.resample_by_distance(v, lap, m, 60.0, 1000.0).collect()
    assert sorted((r.lap_num, r.i) for r in even) == [(0, 0), (1, 0), (1, 1)]
    assert [r.value for r in even if r.i == 0] == [pytest.approx(20.0)] * 2


def test_best_of_laps_without_length(spark):
    kind = "session_id long, lap_num int, start_tc double, end_tc double, start_dist double, end_dist double"
    rows = [(1, 0, 0.0, 5.0, 0.0, 3.0), (1, 1, 5.0, 6.0, 3.0, 3.0 - 4e-16), (1, 2, 6.0, 8.0, 3.0, 3.0), (1, 3, 8.0, 11.0, 3.0, 3.0), (1, 4, 11.0, 15.0, 3.0, 9.0)]
    assert laps.best_lap(spark.createDataFrame(rows, kind)).collect()[0].lap_num == 1


@pytest.mark.parametrize("name", ["a6_best_lap", "j5_dist_to_time", "j6_time_slip", "w7_resample_by_distance", "x1_derive_channels"])
def test_queries_equal_their_sql_with_zeros(spark, tmp_path, name):
    """Of these values one in four is 0: sessions begin, end and turn laps at a standstill, and ratios divide by 0."""
    db = duckdb.connect()
    db.sql("SET timezone = 'UTC'")
    db.sql("""CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(CAST(i * 2000000000 + hash(i) % 1000000000 AS BIGINT)) AS ts, CAST(hash(i + 7000) % 12 AS BIGINT) AS user_id,
        ['click', 'view', 'purchase', 'signup', 'error'][CAST(1 + hash(i + 9000) % 5 AS BIGINT)] AS event_type, CASE WHEN hash(i + 11000) % 4 = 0 THEN 0.0 ELSE CAST(hash(i + 13000) % 20000 AS DOUBLE) / 100 END AS value, '{}' AS props FROM (SELECT unnest(range(0, 1200)) AS i)""")
    db.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    registry.queries()[name](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    db.sql(f"CREATE TABLE wanted AS {registry.oracle_sql()[name]}")
    columns = ", ".join(c for c, *_ in db.sql("DESCRIBE wanted").fetchall())
    got = f"SELECT {columns} FROM '{tmp_path}/out/*.parquet'"
    assert db.sql(f"SELECT count(*) FROM ({got})").fetchall() == db.sql("SELECT count(*) FROM wanted").fetchall() != [(0,)]
    assert db.sql(f"({got}) EXCEPT ALL (SELECT {columns} FROM wanted)").fetchall() == []


def test_a_lap_five_percent_off_is_scaled_whatever_its_speed(spark):
    """At constant speed laps of 19 and 21 seconds are five percent off those of 20: rounding errors of the sums don't decide."""
    speeds = [196.72, 203.92, 322.5, 256.4, 207.89, 364.08, 417.42, *[i * 0.37 + 0.01 for i in range(40)]]
    ends = [0, 7, 27, 46, 66, 87, 107, 125, 140]
    speed = spark.createDataFrame([(i, 30_000.0, v) for i, v in enumerate(speeds)], "session_id long, tc double, value double")
    lap = spark.createDataFrame([(i, n, a * 1000.0, b * 1000.0) for i in range(len(speeds)) for n, (a, b) in enumerate(zip(ends, ends[1:], strict=False))], "session_id long, lap_num int, start_tc double, end_tc double")
    found = distance.build_dist_map(speed, lap, 1000.0).select("session_id", "lap_num", "f").distinct().collect()
    want = [1.0, 1.0, 20 / 19, 1.0, 20 / 21, 1.0, 1.0, 1.0]
    assert sorted((r.session_id, r.lap_num, round(r.f, 9)) for r in found) == [(i, n, round(f, 9)) for i in range(len(speeds)) for n, f in enumerate(want)]
