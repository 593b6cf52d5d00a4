"""Ordered work in buckets: the same rows whatever the width, and no task with more than a bucket's rows."""

from __future__ import annotations

import bisect
import random

import pytest
from pyspark.sql import functions as F

from lapframe.operators import align, buckets, derive, distance, laps, normalize

S = "session_id long, channel string, tc double, value double"
WIDTHS = (1e12, 700.0, 90.0)


@pytest.fixture(scope="module")
def skewed(spark):
    """One session holds half of all samples; gaps leave buckets without samples; some times repeat."""
    rng = random.Random(4)
    rows = []
    for session, n in ((1, 2000), (2, 300), (3, 5), (4, 900)):
        tc = 0.0
        for i in range(n):
            tc += rng.choice([0.0, 1.0, 2.5, 10.0, 10.0, 400.0 if i % 97 == 0 else 1.0])
            rows.append((session, "a" if rng.random() < 0.7 else "b", tc, round(rng.uniform(-5, 50), 2)))
    return spark.createDataFrame(rows, S).repartition(5).cache()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plain_around(samples, at):
    """The samples around a place, of equal places the largest value."""
    best = {}
    for tc, v in samples:
        best[tc] = max(v, best.get(tc, v))
    on = sorted(best)
    i, j = bisect.bisect_right(on, at) - 1, bisect.bisect_left(on, at)
    return (on[i], best[on[i]]) if i >= 0 else None, (on[j], best[on[j]]) if j < len(on) else None


def test_neighbours_and_asof_in_any_width(spark, skewed):
    points = skewed.filter("channel = 'a'").select("session_id", (F.col("tc") + 0.25 * F.floor("value")).alias("tc")).union(spark.createDataFrame([(1, -5.0), (1, 1e7), (9, 3.0)], "session_id long, tc double"))
    samples = skewed.filter("channel = 'b'").drop("channel")
    by = {}
    for r in samples.collect():
        by.setdefault(r.session_id, []).append((r.tc, r.value))
    want = sorted(((r.session_id, r.tc, *[x for side in plain_around(by.get(r.session_id, []), r.tc) for x in (side or (None, None))]) for r in points.collect()), key=repr)
    for width in WIDTHS:
        got = align.neighbours(points, samples, ("session_id",), width=width).select("session_id", "tc", "prev_on", "prev_value", "next_on", "next_value")
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
        last = align.asof(points, samples, ("session_id",), width=width).select("session_id", "tc", "prev_tc", "prev_value")
        assert sorted((tuple(r) for r in last.collect()), key=repr) == sorted((w[:4] for w in want), key=repr)
        strict = align.asof(points, samples, ("session_id",), strict=True, width=width)
        assert all(r.prev_tc is None or r.prev_tc < r.tc for r in strict.collect())


def test_alignment_laps_and_sums_in_any_width(spark, skewed):
    counter = skewed.filter("channel = 'a'").groupBy("session_id", "tc").agg(F.max("value").alias("value")).withColumn("value", F.floor(F.col("tc") / 150).cast("double")).withColumn("channel", F.lit("laps"))
    counter = counter.select("session_id", "channel", "tc", "value")
    lp = laps.laps_from_counter(counter, "laps", 1e12).cache()
    raw = skewed.groupBy("session_id", "tc").agg(F.max("value").alias("v")).withColumn("raw", F.pmod(F.col("tc") * 3, F.lit(1024.0)))
    replayed = skewed.withColumn("seq", F.col("tc") * 8 + F.col("value") / 100).withColumn("tc", F.floor(F.col("tc") / 7) + F.pmod(F.floor("value"), F.lit(5)))
    ask = {
        "align": lambda w: align.align(skewed, {"a": True, "b": False}, width=w),
        "grid": lambda w: align.align(skewed, {"a": True, "b": True}, 100.0, width=w),
        "laps": lambda w: laps.laps_from_counter(counter, "laps", w),
        "lap of": lambda w: align.assign_laps(skewed, lp, width=w),
        "in lap": lambda w: align.assign_laps(skewed, lp, inclusive=True, width=w),
        "unwrap": lambda w: normalize.unwrap_counter(raw, "raw", 1024.0, "tc", name="t", width=w).select("session_id", "tc", F.round("t", 6)),
        "replayed": lambda w: normalize.drop_replayed(replayed, "seq", width=w),
    }
    for name, make in ask.items():
        want = sorted(map(repr, rows(make(WIDTHS[0]))))
        assert want, name
        for width in WIDTHS[1:]:
            assert sorted(map(repr, rows(make(width)))) == want, (name, width)


def test_distance_map_in_any_width(spark, skewed):
    lp = spark.createDataFrame([(s, k, 150.0 * k, 150.0 * (k + 1)) for s in (1, 2, 4) for k in range(20)], "session_id long, lap_num int, start_tc double, end_tc double")
    speed = skewed.filter("channel = 'b'").select("session_id", "tc", F.abs("value").alias("value"))
    make = lambda w: rows(distance.build_dist_map(speed, lp, 10.0, width=w).select("session_id", "k0", "k1", "lap_num", "k_last", "v", "slope", "f", "before", "next_step"))
    want = make(WIDTHS[0])
    for width in WIDTHS[1:]:
        got = make(width)
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert [x or 0.0 for r in got for x in r[5:]] == pytest.approx([x or 0.0 for r in want for x in r[5:]], abs=1e-9)


def test_no_task_holds_more_than_buckets(spark, skewed):
    """Rows of the longest window partition: those of a bucket and its two edges."""
    both = align._united(skewed.filter("channel = 'a'").select("session_id", "tc"), skewed.filter("channel = 'b'"), ("session_id",), "tc", ["value"], 90.0)
    per = both.groupBy("session_id", "_bucket").count()
    within = skewed.groupBy("session_id", F.floor(F.col("tc") / 90)).count()
    assert per.agg(F.max("count")).first()[0] <= within.agg(F.max("count")).first()[0] + 2
    plan = align.interp_join(skewed.select("session_id", "tc"), skewed.drop("channel"), ("session_id",))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert sum("_bucket" in w.split("], [")[1] for w in windows) >= 1
    assert buckets.BUCKET_MS == 600_000.0


def test_many_laps_meet_in_tiles(spark):
    """5 000 laps in a session: a sample meets those of its tile only."""
    lp = spark.range(5000).select(F.lit(1).cast("long").alias("session_id"), F.col("id").cast("int").alias("lap_num"), (F.col("id") * 1000.0).alias("start_tc"), ((F.col("id") + 1) * 1000.0).alias("end_tc"))
    s = spark.range(20_000).select(F.lit(1).cast("long").alias("session_id"), F.lit("x").alias("channel"), (F.col("id") * 250.0).alias("tc"), F.lit(0.0).alias("value"))
    got = align.assign_laps(s, lp, width=2000.0)
    assert got.count() == 20_000 and got.filter("lap_num <> floor(tc / 1000)").count() == 0


def test_functions_in_chunks_and_with_halo(spark, skewed):
    channels = {"a": False, "b": False}
    derive.register_channel_fn("gap so far", lambda pdf: (pdf["a"] - pdf["b"]).cumsum())
    derive.register_channel_fn("gap in chunks", lambda pdf, state: ((total := (pdf["a"] - pdf["b"]).cumsum() + (state or 0.0)), float(total.iloc[-1])))
    keep = lambda df: rows(df.select("session_id", "channel", "tc", F.round("value", 6) + 0.0))
    want = keep(derive.apply_channel_fn(skewed, "gap so far", channels, "run"))
    for n in (1000, 7):
        assert keep(derive.apply_channel_fn_in_chunks(skewed, "gap in chunks", channels, "run", n)) == want
    derive.register_channel_fn("mean near", lambda pdf: [pdf["a"][(pdf["tc"] - t).abs() <= 20].mean() for t in pdf["tc"]])
    whole = keep(derive.apply_channel_fn(skewed, "mean near", channels, "near"))
    assert keep(derive.apply_channel_fn(skewed, "mean near", channels, "near", halo_ms=20.0, width=90.0)) == whole
