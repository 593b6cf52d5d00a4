"""Small literal tables for the edges of joins, laps, distance, units and reports."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lapframe.functions import geo, units
from lapframe.operators import align, derive, distance, laps, normalize, reports, tracks
from lapframe.sources import catalog, storage, text_logs

S = "session_id long, channel string, tc double, value double"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_interpolation_clamps_and_holds(spark):
    s = spark.createDataFrame([(1, "a", 10.0, 1.0), (1, "a", 20.0, 3.0), (1, "a", 20.0, 5.0), (1, "b", 0.0, 9.0)], S)
    p = spark.createDataFrame([(1, "a", float(t)) for t in (0, 10, 15, 20, 30)] + [(2, "a", 1.0)], "session_id long, channel string, tc double")
    assert [r[3] for r in rows(align.interp_join(p, s), "session_id", "tc")] == [1.0, 1.0, 3.0, 5.0, 5.0, None]
    assert [r[3] for r in rows(align.hold_join(p, s), "session_id", "tc")] == [1.0, 1.0, 1.0, 5.0, 5.0, None]


def test_laps_are_half_open_unless_asked(spark):
    s = spark.createDataFrame([(1, "a", float(t), 0.0) for t in (-1, 0, 5, 10, 15, 20)], S)
    lp = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 10.0, 20.0), (1, 2, 20.0, 20.0)], "session_id long, lap_num int, start_tc double, end_tc double")
    assert [(r[2], r[4]) for r in rows(align.assign_laps(s, lp), "tc", "lap_num")] == [(0.0, 0), (5.0, 0), (10.0, 1), (15.0, 1)]
    assert [(r[2], r[4]) for r in rows(align.slice_lap(s, lp), "tc", "lap_num")] == [(0.0, 0), (5.0, 0), (10.0, 0), (10.0, 1), (15.0, 1), (20.0, 1)]


def test_best_lap_rules(spark):
    kind = "session_id long, lap_num int, start_tc double, end_tc double, start_dist double, end_dist double"
    two = [(1, 0, 0.0, 9.0, 0.0, 1.0), (1, 1, 9.0, 13.0, 1.0, 9.0)]
    more = [(2, 0, 0.0, 1.0, 0.0, 9.0), (2, 1, 1.0, 11.0, 0.0, 100.0), (2, 2, 11.0, 16.0, 0.0, 50.0), (2, 3, 16.0, 25.0, 0.0, 99.0), (2, 4, 25.0, 34.0, 0.0, 101.0), (2, 5, 34.0, 35.0, 0.0, 99.0)]
    got = rows(laps.best_lap(spark.createDataFrame(two + more + [(3, 7, 0.0, 5.0, 0.0, 0.0)], kind)), "session_id")
    assert [(r[0], r[1]) for r in got] == [(1, 1), (2, 3), (3, 7)]


def test_distance_map_equals_the_grid(spark):
    pts = [(1, t * 137.0, 5 + 20 * abs(math.sin(t / 5))) for t in range(60)]
    lp = [(1, 0, 0.0, 1500.0), (1, 1, 1500.0, 3600.0), (1, 2, 3600.0, 5700.0), (1, 3, 5700.0, 8000.0)]
    speed = spark.createDataFrame(pts, "session_id long, tc double, value double")
    table = spark.createDataFrame(lp, "session_id long, lap_num int, start_tc double, end_tc double")
    m = distance.build_dist_map(speed, table, 10.0).cache()
    grid = rows(distance.dist_grid(m, 10.0), "tc")
    assert len(grid) == 800
    at = lambda t: next(v0 + (v1 - v0) * (t - t0) / (t1 - t0) for (_, t0, v0), (_, t1, v1) in zip(pts, pts[1:]) if t0 <= t <= t1)
    step = [at(min(k * 10.0, pts[-1][1])) / 100 for k in range(800)]
    inner = [sum(step[150:360]), sum(step[360:570])]
    mid = sum(inner) / 2
    for (a, b), length in zip(((150, 360), (360, 570)), inner, strict=True):
        if abs(length - mid) / mid <= 0.05:
            step[a:b] = [x * mid / length for x in step[a:b]]
    total = 0
    for r, x in zip(grid, step, strict=True):
        total += x
        assert r[2] == pytest.approx(total, abs=1e-9)
    assert all(b[2] > a[2] for a, b in zip(grid, grid[1:], strict=False))
    p = spark.createDataFrame([(1, float(t)) for t in (0, 3, 1234.5, 5700, 7990, 9999)], "session_id long, tc double")
    back = distance.dist_to_time(distance.time_to_dist(p, m, 10.0).withColumnRenamed("tc", "was"), m, 10.0)
    for r in back.collect():
        assert r.tc == pytest.approx(min(r.was, 7990.0), abs=1e-6)


def test_units(spark):
    s = spark.createDataFrame([(1, "t", "C", 0.0, 100.0), (1, "v", "KPH", 0.0, 36.0), (1, "x", "furlong", 0.0, 1.0), (1, "p", "bar", 0.0, 1.0), (1, "q", "furlong", 0.0, 2.0), (1, "m", "mi", 0.0, 3.0)], "session_id long, channel string, units string, tc double, value double")
    to = spark.createDataFrame([("t", "F"), ("v", "m/s"), ("x", "m"), ("p", "m"), ("q", "Furlong"), ("m", "mile")], "channel string, to_units string")
    got = {r.channel: r.value for r in units.convert_units(s, to).collect()}
    assert got == {"t": pytest.approx(212.0), "v": pytest.approx(10.0), "q": 2.0, "m": 3.0}


def test_histogram_sums_to_100_and_flat_channels_fit(spark):
    s = spark.createDataFrame([(1, "a", float(t), float(t % 7)) for t in range(50)] + [(1, "b", float(t), 3.0) for t in range(5)] + [(1, "b", 9.0, float("nan"))], S)
    h = reports.weighted_histogram(s, bins=5)
    assert {round(r[1], 9) for r in rows(h.groupBy("channel").agg(F.sum("percent")), "channel")} == {100.0}
    flat = reports.weighted_histogram(s.filter("channel = 'b'"), bins=5).collect()
    assert [(r.bin, r.percent) for r in flat] == [(0, 100.0)]


def test_counter_wraps_and_midnight(spark):
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate((65530.0, 3.0, 3.0, 60000.0, 10.0))], "session_id long, seq int, raw double")
    assert [r.tc for r in normalize.unwrap_counter(d, "raw", 65536.0, "seq").orderBy("seq").collect()] == [65530.0, 65539.0, 65539.0, 125536.0, 131082.0]


def test_messages_infer_one_lap_and_reject_more(spark):
    kind = "session_id long, seq int, segment int, lap int, duration double, end_tc double"
    got = rows(laps.laps_from_messages(spark.createDataFrame([(1, 1, 0, 4, 10.0, 10.0), (1, 2, 1, 5, 1.0, 12.0), (1, 3, 0, 6, 8.0, 30.0), (1, 4, 0, 6, 8.0, 30.0)], kind)), "lap_num")
    assert got == [(1, 4, 0.0, 10.0), (1, 5, 10.0, 22.0), (1, 6, 22.0, 30.0)]
    with pytest.raises(Exception, match="lap gap"):
        laps.laps_from_messages(spark.createDataFrame([(1, 1, 0, 4, 1.0, 1.0), (1, 2, 0, 9, 1.0, 9.0)], kind)).collect()


def test_beacons(spark):
    b = [(1, "Beacon", 100.0 + i, float(v)) for i, v in enumerate((0, -1, 16384 + 8192, 100, -5, 16384 + 7, 56, -9, 100))] + [(1, "x", 500.0, 0.0)]
    assert [(r[2], r[3]) for r in rows(laps.laps_from_beacon(spark.createDataFrame(b, S)), "lap_num")][:1] == [(0.0, -9091.0)]


def test_ecef_round_trip(spark):
    p = spark.createDataFrame([(1, float(i), lat, lon, alt) for i, (lat, lon, alt) in enumerate([(45.0, 9.0, 0.0), (-33.5, 151.0, 700.0), (80.0, -179.0, 8000.0), (0.1, 0.1, -50.0)])], "session_id long, tc double, lat double, lon double, alt double")
    x = p.select("*", *[(c * 100).alias(f"ecef_{n}") for n, c in zip("xyz", geo.lla_to_ecef(F.col("lat"), F.col("lon"), F.col("alt")), strict=True)]).withColumns({f"ecef_{d}": F.lit(0.0) for d in ("dx", "dy", "dz")})
    s = x.unpivot(["session_id", "tc"], [c for c in x.columns if c.startswith("ecef")], "channel", "value")
    got = {(r.tc, r.channel): r.value for r in normalize.ecef_to_lla(s).collect()}
    for r in p.collect():
        for n, tol in (("lat", 1e-8), ("lon", 1e-8), ("alt", 1e-3)):
            assert got[(r.tc, n)] == pytest.approx(r[n], abs=tol)


def test_stationary_positions_have_no_crossings(spark):
    f = spark.createDataFrame([(1, i * 1000.0, 45.0, 9.0) for i in range(20)], "session_id long, tc double, lat double, lon double")
    line = spark.createDataFrame([(1, 45.0, 9.0)], "session_id long, lat double, lon double")
    assert tracks.line_crossings(f, line).count() == 0
    assert rows(tracks.laps_from_gps(f, line), "lap_num") == [(1, 0, 0.0, 19000.0)]


def test_segments_of_a_track(spark):
    rate = [0] * 60 + [200] * 30 + [0] * 10 + [200] * 20 + [0] * 40 + [-200] * 30 + [0] * 10 + [300] * 5 + [0] * 50
    t = spark.createDataFrame([(1, i, float(r)) for i, r in enumerate(rate)], "track_id long, seq long, rate double")
    got = [(r.kind, r.start_seq, r.end_seq) for r in tracks.segment_track(t).orderBy("seg").collect()]
    assert got[:3] == [("Straight", 0, 60), ("Right", 60, 120), ("Straight", 120, 160)] and got[3][0] == "Left" and got[-1][2] == 255


def test_nearest_on_track_and_far_points(spark):
    track = spark.createDataFrame([(1, i, 45.0, 9.0 + i * 0.001) for i in range(5)], "track_id long, seq int, lat double, lon double")
    p = spark.createDataFrame([(1, 0.0, 45.0001, 9.0015, 1), (1, 1.0, 46.0, 9.0, 1)], "session_id long, tc double, lat double, lon double, track_id long")
    a, b = tracks.nearest_on_track(p, track, 30.0).orderBy("tc").collect()
    assert a.idx == pytest.approx(1.5, abs=1e-6) and a.off == pytest.approx(11.12, abs=0.01) and b.idx is None
    a, b = tracks.nearest_on_track(p, track).orderBy("tc").collect()
    assert a.off == pytest.approx(11.12, abs=0.01) and b.idx == 0 and b.off == pytest.approx(111_195, rel=1e-3)


def test_turn_rate_of_a_circle_and_closed_loop(spark):
    n, r = 400, 100.0  # clockwise, a metre or so to a step
    pts = [(1, i, 45 + r * math.cos(2 * math.pi * i / n) / 111_195, 9 + r * math.sin(2 * math.pi * i / n) / (111_195 * math.cos(math.radians(45))), 20.0) for i in range(n)]
    p = spark.createDataFrame(pts, "track_id long, seq int, lat double, lon double, speed double")
    mid = [x.rate for x in tracks.turn_rate(p, 2 * math.pi * r / n).orderBy("seq").collect()][50:300]
    steps = max(1, round(10 / (2 * math.pi * r / n)))
    assert all(x == pytest.approx(20 * steps * 360 / n, rel=0.02) for x in mid)
    open_ = spark.createDataFrame([(1, i, 45.0 + i * 1e-5, 9.0) for i in range(5)] + [(2, i, 45.0 + i * 1e-2, 9.0) for i in range(3)], "track_id long, seq int, lat double, lon double")
    got = tracks.close_loop(open_).collect()
    assert {round(r.lat, 9) for r in got if r.track_id == 1} == {45.0} and len({r.lat for r in got if r.track_id == 2}) == 3


def test_scatter_pairs_skip_rows(spark):
    s = spark.createDataFrame([(1, "x", float(t), float(t)) for t in range(10)] + [(1, "y", 0.0, 0.0), (1, "y", 9.0, 18.0)], S)
    lp = spark.createDataFrame([(1, 0, 0.0, 9.0)], "session_id long, lap_num int, start_tc double, end_tc double")
    assert [(r.x, r.y) for r in reports.scatter_pairs(s, lp, "x", "y", 4).orderBy("tc").collect()] == [(float(t), 2.0 * t) for t in range(0, 10, 2)]


def test_derived_channels_order_cycles_and_division(spark):
    s = spark.createDataFrame([(1, "a", 0.0, 1.0), (1, "a", 1.0, 2.0), (1, "b", 0.0, 0.0), (1, "b", 1.0, 4.0)], S)
    made = [derive.Derived("z", "y + 1", {"y": "y"}), derive.Derived("y", "a * 2", {"a": "a"}), derive.Derived("y", "a * 9", {"a": "a"}), derive.Derived("c1", "x", {"x": "c2"}), derive.Derived("c2", "x", {"x": "c1"}), derive.Derived("inf", "a / nullif(b, 0) + ln(b)", {"a": "a", "b": "b"}), derive.Derived("off", "a", {"a": "a"}, enabled=False)]
    assert [d.name for d in derive.ordered(made)] == ["y", "z", "inf"]
    got = rows(derive.derive_channels(s, made), "channel", "tc")
    assert [(r[1], r[2], r[3]) for r in got if r[1] != "inf"] == [("y", 0.0, 2.0), ("y", 1.0, 4.0), ("z", 0.0, 3.0), ("z", 1.0, 5.0)]


def test_search(spark):
    c = spark.createDataFrame([("GPS_Speed",), ("wheel speed FL",), ("rpm",), ("",)], "channel string")
    names = lambda t: {r.channel for r in catalog.search_channels(c, t).collect()}
    assert names("sp") == {"GPS_Speed", "wheel speed FL"} and names("sp gps") == {"GPS_Speed"} and names("*l") == {"wheel speed FL"} and names("") == {"GPS_Speed", "wheel speed FL", "rpm"} and names("PM") == set()


def test_text_logs_and_storage(spark, tmp_path):
    (tmp_path / "a.log").write_text('"Interval"|"ms","Speed"|"km/h","Gear"|""\n100,1.50,\n110,,3\n120,2.5,x\n')
    got = rows(text_logs.read_wide_log(spark, str(tmp_path), "*.log").select("channel", "units", "tc", "value"), "channel", "tc")
    assert got == [("Gear", "", 10.0, 3.0), ("Speed", "km/h", 0.0, 1.5), ("Speed", "km/h", 20.0, 2.5)]
    dec = {r.channel: r.dec_pts for r in normalize.infer_decimals(text_logs.decimals(spark, str(tmp_path), "*.log")).collect()}
    assert dec["Speed"] == 2 and dec["Gear"] == 0
    (tmp_path / "b.vbo").write_text("[header]\nsatellites\ntime\nlatitude\nlongitude\nboost\n\n[channel units]\ns\nkPa\n[laptiming]\nStart 60 120 180 240\n\n[data]\n9 235959.500 2700.0 -540.0 1.5\n9 000000.500 2701.0 -541.0 1.6\n\n1 2 3 4 5\n")
    got = rows(text_logs.read_sectioned_log(spark, str(tmp_path), "*.vbo").select("channel", "units", "tc", "value"), "channel", "tc")
    assert got[0] == ("boost", "kPa", 0.0, 1.5) and got[1] == ("boost", "kPa", 1000.0, 1.6) and ("longitude", "deg", 0.0, 9.0) in got and len(got) == 8
    assert [(r.lat, r.lon) for r in text_logs.lap_marker(spark, str(tmp_path), "*.vbo").collect()] == [(3.0, -2.0)]
    assert {r.format for r in catalog.scan_catalog(spark, str(tmp_path)).collect()} == {"wide text", "sectioned text"}
    s = spark.createDataFrame([(1, "a", 0.0, 1.0), (2, "b", 0.0, 2.0)], S)
    storage.write_samples(s, f"{tmp_path}/samples")
    assert rows(storage.read_samples(spark, f"{tmp_path}/samples", [1], ["a", "b"]), "tc") == [(1, "a", 0.0, 1.0)]


def test_headers_are_first_lines_and_metadata_of_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text('"Interval"|"ms","Utc"|"ms","Speed"|"km/h"\n100,1700000000000,1.5\n,9.9,7\n120,,2.5\n')
    (tmp_path / "b.log").write_text('"Interval"|"ms","Speed"|"km/h"\n5,4\n')
    (tmp_path / "c.log").write_text("File created on 03/02/2024 at 10:11:12\n")
    got = text_logs.read_wide_log(spark, str(tmp_path), "*.log").filter("channel = 'Speed'").select("tc", "value")
    assert rows(got, "value") == [(0.0, 1.5), (20.0, 2.5), (0.0, 4.0)]
    m = text_logs.log_metadata(spark, str(tmp_path), "*.log").withColumnRenamed("path", "session_id")
    by = {r.session_id[-5]: r for r in catalog.session_metadata(m).collect()}
    assert by["a"].metadata == {"Log Date": "11/14/2023", "Log Time": "22:13:20"} and by["a"].started_at is not None
    assert by["b"].readable and by["b"].metadata == {} and by["c"].metadata == {"Log Date": "03/02/2024", "Log Time": "10:11:12"} and by["c"].format == "sectioned text"
    twice = spark.createDataFrame([(1, "x", "Driver", "b"), (1, "x", "Driver", "a")], "session_id long, format string, key string, value string")
    assert catalog.session_metadata(twice).first().metadata == {"Driver": "a"}


def test_expressions_with_units_constants_and_nan_rules(spark):
    s = spark.createDataFrame([(1, "v", 0.0, 36.0, "km/h"), (1, "v", 2000.0, 72.0, "km/h"), (1, "n", 0.0, float("nan"), "")], S + ", units string")
    made = [derive.Derived("ms", "v", {"v": "v"}, units={"v": "m/s"}), derive.Derived("both", "v / w", {"v": "v", "w": "v"}, units={"w": "m/s"}), derive.Derived("three", "1 + 2", {}), derive.Derived("lost", "v", {"v": "v"}, units={"v": "bar"}), derive.Derived("low", "nan_min(v, 50)", {"v": "v"}), derive.Derived("nan", "nan_max(n, 1)", {"n": "n"})]
    got = rows(derive.derive_channels(s, made), "channel", "tc")
    near = [(r[1], r[2], round(r[3], 6)) for r in got]
    assert near == [("both", 0.0, 3.6), ("both", 2000.0, 3.6), ("low", 0.0, 36.0), ("low", 2000.0, 50.0), ("ms", 0.0, 10.0), ("ms", 2000.0, 20.0), ("three", 0.0, 3.0), ("three", 1000.0, 3.0), ("three", 2000.0, 3.0)]


def test_opposite_turns_are_split_where_the_rate_changes_sign(spark):
    rate = [0] * 40 + [200] * 30 + [90, 60, 40, -10, -80, -100, -120, -140] + [-200] * 30 + [0] * 50
    t = spark.createDataFrame([(1, i, float(r)) for i, r in enumerate(rate)] + [(1, 500, None)], "track_id long, seq long, rate double")
    got = [(r.kind, r.start_seq, r.end_seq) for r in tracks.segment_track(t).orderBy("seg").collect()]
    assert got == [("Straight", 0, 40), ("Right", 40, 73), ("Left", 73, 108), ("Straight", 108, 158)]


def test_cursor_by_distance_and_baseline(spark):
    lp = spark.createDataFrame([(1, k, 10_000.0 * k, 10_000.0 * (k + 1)) for k in range(4)], "session_id long, lap_num int, start_tc double, end_tc double")
    v = spark.createDataFrame([(1, "v", t * 1000.0, 10.0) for t in range(41)] + [(1, "a", t * 1000.0, float(t)) for t in range(41)], S)
    m = distance.build_dist_map(v.filter("channel = 'v'").select("session_id", "tc", "value"), lp, 100.0)
    laps_ = distance.with_lap_distances(lp, m, 100.0)
    got = rows(reports.values_at_cursor(v, laps_, {"a": True}, 50.0, m, 2, 100.0).select("lap_num", "value", "delta"), "lap_num")
    assert [r[0] for r in got] == [0, 1, 2, 3]
    assert all(r[1] == pytest.approx(10 * r[0] + 5, abs=0.11) and r[2] == pytest.approx(10.0 * (r[0] - 2), abs=0.11) for r in got)
    part = distance.slice_distance(v.filter("channel = 'a'"), laps_, m, 20.0, 40.0, grid_ms=100.0)
    assert {(r.lap_num, r.tc) for r in part.collect()} == {(k, 10_000.0 * k + x) for k in range(4) for x in (2000.0, 3000.0)}


def test_tables_over_channels_and_inverse_positions(spark):
    s = spark.createDataFrame([(1, c, float(t), float(t * k)) for t in range(6) for c, k in (("x", 1), ("y", 2), ("v", 10))], S)
    cells = reports.value_table(s, "v", "x", "y", 2.0, 4.0, 60.0)
    got = {(r.x_cell, r.y_cell): (r.mean_value, r.n) for r in cells.collect()}
    assert got == {(0.0, 0.0): (5.0, 2), (2.0, 4.0): (20.0, 1), (4.0, 8.0): (40.0, 3)} and reports.matrix(cells).count() == 3
    x, y = geo.mercator(F.lit(45.0), F.lit(9.0))
    back = spark.range(1).select(*[c.alias(n) for n, c in zip("ab", geo.mercator_inverse(x, y), strict=True)]).first()
    assert (back.a, back.b) == pytest.approx((45.0, 9.0))


def test_entry_and_registry(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and len(names) > 70
    assert __spark_entry__.entry(spark).columns == ["session_id", "tc", "value"]


def test_ecef_channels_are_gathered_in_one_shuffle(spark):
    names = ("ecef_x", "ecef_y", "ecef_z", "ecef_dx", "ecef_dy", "ecef_dz")
    s = spark.createDataFrame([(1, 0.0, n, v) for n, v in zip(names, (637813700.0, 0.0, 0.0, 300.0, 400.0, 1200.0), strict=True)] + [(1, 1.0, "ecef_x", 5.0)], "session_id long, tc double, channel string, value double")
    found = normalize.ecef_to_lla(s)
    assert {(r.tc, r.channel): round(r.value, 6) for r in found.collect() if r.tc == 0} == {(0.0, "lat"): 0.0, (0.0, "lon"): 0.0, (0.0, "alt"): 0.0, (0.0, "speed"): 13.0}
    assert found._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 2 and "pivot" not in found._jdf.queryExecution().optimizedPlan().toString()
