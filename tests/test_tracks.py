"""A track built from one session, as a whole, and merges of segments against a plain restatement."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lapframe.operators import distance, tracks

METRE = 180 / (math.pi * 6371008.8)


def stadium(d: float, straight: float = 300.0, radius: float = 60.0) -> tuple[float, float]:
    """Metres east and north after d metres, clockwise: two straights joined by half circles."""
    bend = math.pi * radius
    d %= 2 * (straight + bend)
    if d < straight:
        return 0.0, d
    if d < straight + bend:
        a = (d - straight) / radius
        return radius - radius * math.cos(a), straight + radius * math.sin(a)
    if d < 2 * straight + bend:
        return 2 * radius, straight - (d - straight - bend)
    a = (d - 2 * straight - bend) / radius
    return radius + radius * math.cos(a), -radius * math.sin(a)


def test_a_stadium_becomes_a_track_with_two_turns(spark):
    """Four and a half laps at 30 m/s, ten positions a second; the line lies in the middle of the first straight."""
    length = 2 * (300 + math.pi * 60)
    k = math.cos(math.radians(45))
    rows, n = [], int(4.5 * length / 3)
    for i in range(n):
        x, y = stadium(i * 3.0)
        rows.append((1, i * 100.0, 45 + y * METRE, 9 + x * METRE / k, 30.0))
    f = spark.createDataFrame(rows, "session_id long, tc double, lat double, lon double, speed double").withColumn("alt", F.lit(0.0)).cache()
    line = spark.createDataFrame([(1, 45 + 150 * METRE, 9.0)], "session_id long, lat double, lon double")
    laps = tracks.laps_from_gps(f, line).cache()
    assert laps.count() == 6
    m = distance.build_dist_map(f.select("session_id", "tc", F.col("speed").alias("value")), laps, 10.0).cache()
    s = f.unpivot(["session_id", "tc"], ["lat", "lon", "speed"], "channel", "value")
    path = tracks.best_lap_path(s, distance.with_lap_distances(laps, m, 10.0), m, "lat", "lon", "speed").cache()
    assert path.count() == pytest.approx(length, abs=3)
    ends = {r.seq: (r.lat, r.lon) for r in path.collect()}
    assert ends[0] == pytest.approx(ends[max(ends)], abs=2 * METRE)
    points, parts = tracks.build_track(path)
    assert points.count() == pytest.approx(length / 10, abs=2)
    got = [(r.kind, r.name, r.start_seq, r.end_seq, r.dist) for r in parts.orderBy("seg").collect()]
    turns = [g for g in got if g[0] == "Right"]
    assert len(turns) == 2 and not any(g[0] == "Left" for g in got) and [g[1] for g in turns] == ["Turn 1", "Turn 2"]
    # Turns begin and end within some metres of the half circles (150 m after the line the first begins).
    for g, begin in zip(turns, (150.0, 450 + math.pi * 60), strict=True):
        assert g[2] == pytest.approx(begin, abs=15) and g[3] == pytest.approx(begin + math.pi * 60, abs=15) and g[4] == pytest.approx(g[2], abs=3)


def plain_segments(rates, limit=150.0, spacing=4.0):
    """The rules on a list of runs, read straight from their statement."""
    kind = lambda r: "R" if r > limit else "L" if r < -limit else "S"
    runs = []
    for i, r in enumerate(rates):
        if runs and runs[-1]["kind"] == kind(r):
            if runs[-1]["cross"] is None and (r > 0) != (rates[i - 1] > 0):
                runs[-1]["cross"] = i
            runs[-1]["b"] = i + 1
        else:
            runs.append({"kind": kind(r), "a": i, "b": i + 1, "cross": None})
    for which in ("straights", "turns"):
        kept = [True] * len(runs)
        for i in range(len(runs) - 2, 1, -1):
            after = next((j for j in range(i + 1, len(runs)) if kept[j]), None)
            own = runs[i]
            if after is None or (own["kind"] == "S") != (which == "straights") or (own["b"] - own["a"]) * spacing >= (25 if which == "straights" else 10):
                continue
            if which == "turns" or runs[i - 1]["kind"] == runs[after]["kind"]:
                runs[i - 1]["b"] = runs[after]["b"]
                kept[i] = kept[after] = False
            elif own["cross"] is not None:
                runs[i - 1]["b"] = runs[after]["a"] = own["cross"]
                kept[i] = False
        runs = [r for r, k in zip(runs, kept, strict=True) if k]
    return [(r["kind"], r["a"], r["b"]) for r in runs]


def test_segments_of_random_rates(spark):
    rng = random.Random(2)
    tracks_ = {t: [float(rng.choice([0, 10, -20, 200, -200, 160]) if rng.random() < 0.4 else 0) for _ in range(rng.randrange(1, 120))] for t in range(60)}
    for t in range(60, 90):
        tracks_[t] = [rng.uniform(-400, 400) for _ in range(rng.randrange(1, 80))]
    df = spark.createDataFrame([(t, i, r) for t, rs in tracks_.items() for i, r in enumerate(rs)], "track_id long, seq long, rate double")
    got = {}
    for r in tracks.segment_track(df, spacing_m=4.0).orderBy("track_id", "seg").collect():
        got.setdefault(r.track_id, []).append((r.kind[0], r.start_seq, r.end_seq))
    assert got == {t: plain_segments(rs) for t, rs in tracks_.items()}


def test_far_points_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(tracks, "FAR_A_TASK", 100)
    track = spark.createDataFrame([(0, i, 45 + 0.001 * i, 9.0) for i in range(20)], "track_id long, seq long, lat double, lon double")
    points = spark.range(1000).select((F.col("id") % 10).alias("session_id"), F.col("id").cast("double").alias("tc"), F.lit(0).cast("long").alias("track_id"), F.lit(45.0105).alias("lat"), F.lit(9.02).alias("lon"))
    dealt = []
    monkeypatch.setattr(tracks, "_closest_of_each", lambda p, *a, _own=tracks._closest_of_each, **k: (dealt.append(p), _own(p, *a, **k))[1])
    found = tracks.nearest_on_track(points, track)
    assert found.count() == 1000 and found.filter("abs(idx - 10.5) < 1e-6 AND off > 1000").count() == 1000
    assert dealt[-1].rdd.getNumPartitions() == 10


def test_a_lap_is_resampled_without_a_shuffle_of_its_places(spark):
    """The same values as of all channels one by one; standstills and channels with times of their own included."""
    rng = random.Random(7)
    speeds, rows = [], []
    for s in range(6):
        speeds += [(s, 1000.0 * i + rng.choice([0.0, 137.0]), rng.choice([0.0, 0.0, 5.0, 12.5, 30.0])) for i in range(120)]
        rows += [(s, c, rng.uniform(-5000, 130_000), rng.uniform(0, 9)) for c, n in (("a", 300), ("b", 15), ("c", 1)) for _ in range(n)]
    speed = spark.createDataFrame(speeds, "session_id long, tc double, value double").cache()
    samples = spark.createDataFrame(rows, "session_id long, channel string, tc double, value double").cache()
    laps = spark.createDataFrame([(s, n, a, b) for s in range(6) for n, (a, b) in enumerate([(0.0, 30_250.0), (30_250.0, 80_010.0), (80_010.0, 119_000.0)])], "session_id long, lap_num int, start_tc double, end_tc double")
    m = distance.build_dist_map(speed, laps, 100.0).cache()
    best = distance.with_lap_distances(laps, m, 100.0).filter("lap_num = session_id % 3").cache()
    path = distance.resample_lap(samples, best, m, ["a", "b", "c"], 2.0, 100.0)
    plan = path._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.find("Generate explode") < plan.find("Exchange") and "Join" not in plan
    got = {(r.session_id, r.i, c): r[c] for r in path.collect() for c in "abc"}
    want = {(r.session_id, r.i, r.channel): r.value for r in distance.resample_by_distance(samples, best, m, 2.0, 100.0).collect()}
    assert len(want) > 3000 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_starts_meet_their_own_track_and_no_cells(spark):
    track = spark.createDataFrame([(t, i, 45 + 0.0001 * i, 9.0 + t) for t in range(3) for i in range(30)], "track_id long, seq long, lat double, lon double")
    at = spark.createDataFrame([(t, float(i), t, 45 + 0.0001 * i + 0.00002, 9.0 + t + (0.5 if i == 7 else 0.0001)) for t in range(3) for i in range(20)], "session_id long, tc double, track_id long, lat double, lon double")
    got = {(r.session_id, r.tc): (r.idx, r.off) for r in tracks.nearest_on_own_track(at, track).collect()}
    want = {(r.session_id, r.tc): (r.idx, r.off) for r in tracks.nearest_on_track(at, track).collect()}
    assert len(got) == 60 and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_near_points_are_not_joined_with_points_again(spark):
    track = spark.createDataFrame([(0, i, 45 + 0.001 * i, 9.0) for i in range(20)], "track_id long, seq long, lat double, lon double")
    points = spark.createDataFrame([(1, float(i), 0, 45.0105, 9.0 + off, "x") for i, off in enumerate((0.0001, 0.0001, 0.02))], "session_id long, tc double, track_id long, lat double, lon double, note string")
    near = tracks._nearest_within(points.repartition(9, "session_id"), track, 30.0)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and near.rdd.getNumPartitions() == 9
    assert near.columns == [*points.columns, "idx", "off"]
    assert sorted((r.tc, r.note, r.off is None) for r in near.collect()) == [(0.0, "x", False), (1.0, "x", False), (2.0, "x", True)]


def test_far_points_are_not_joined_with_themselves(spark):
    """A join on points' own keys broadcasts them all: on disk they are few bytes."""
    track = spark.createDataFrame([(1, i, 45 + 0.004 * math.sin(i / 5), 9 + 0.006 * math.cos(i / 5)) for i in range(32)], "track_id long, seq long, lat double, lon double")
    points = spark.createDataFrame([(s, float(i), 45 + off, 9 + 0.001 * i, t) for s, off, t in ((1, 0.1, 1), (2, 9.0, 1), (3, 0.1, 2)) for i in range(20)], "session_id long, tc double, lat double, lon double, track_id long")
    runs = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    before = runs().size()
    got = tracks.nearest_on_track(points, track).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [runs().apply(i).physicalPlanDescription() for i in range(before, runs().size())]
    assert plans and not any("Left keys" in line and "session_id" in line for plan in plans for line in plan.splitlines())
    assert sorted((r.session_id, r.tc) for r in got) == sorted((s, float(i)) for s in (1, 2, 3) for i in range(20))
    assert all((r.off is None) == (r.session_id == 3) for r in got)


def test_tables_of_all_tracks_are_not_broadcast(spark):
    """Parts and marks of all tracks are a few bytes a row on disk: by that they look small."""
    path = spark.createDataFrame([(t, i, 45 + stadium(i)[1] * METRE, 9 + stadium(i)[0] * METRE, 30.0) for t in (1, 2) for i in range(900)], "track_id long, seq long, lat double, lon double, speed double")
    runs = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    before = runs().size()
    points, parts = tracks.build_track(path, limit=40.0)
    assert parts.filter("dist IS NOT NULL").count() == parts.count() >= 4
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [runs().apply(i).physicalPlanDescription() for i in range(before, runs().size())]
    assert plans and not any("BroadcastHashJoin" in plan or "BroadcastNestedLoopJoin" in plan for plan in plans)
