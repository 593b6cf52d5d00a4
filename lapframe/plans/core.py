"""Queries for joins, laps, distance and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.units import comparable_units, convert_units
from ..operators import align, distance, laps, reports
from . import fixtures as fx
from .fixtures import out, sql

QUERIES, SQL = {}, {}


def query(name: str, text: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if text:
            SQL[name] = sql(text)
        return fn

    return keep


def _points(spark, sf):
    return fx.samples(spark, sf).filter("channel = 'click'").select("session_id", "tc")


_AROUND = "SELECT p.session_id, p.tc, a.tc AS t0, a.value AS v0 FROM (SELECT * FROM fx_samples WHERE channel = 'click') p ASOF LEFT JOIN (SELECT * FROM fx_samples WHERE channel = 'view') a ON p.session_id = a.session_id AND p.tc >= a.tc"
_BOTH = f"SELECT b.*, n.tc AS t1, n.value AS v1 FROM ({_AROUND}) b ASOF LEFT JOIN (SELECT * FROM fx_samples WHERE channel = 'view') n ON b.session_id = n.session_id AND b.tc <= n.tc"


@query("j1_interp_join", f"SELECT session_id, tc, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (tc - t0) / (t1 - t0) END, 6) AS value FROM ({_BOTH})")
def j1(spark, sf):
    return out(align.interp_join(_points(spark, sf), fx.samples(spark, sf).filter("channel = 'view'").drop("channel"), ("session_id",)))


@query("j2_hold_join", f"SELECT session_id, tc, round(coalesce(v0, v1), 6) AS value FROM ({_BOTH})")
def j2(spark, sf):
    return out(align.hold_join(_points(spark, sf), fx.samples(spark, sf).filter("channel = 'view'").drop("channel"), ("session_id",)))


def _held(c):
    return f"coalesce(last_value(CASE WHEN channel = '{c}' THEN value END IGNORE NULLS) OVER w, first_value(CASE WHEN channel = '{c}' THEN value END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY tc ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


@query("j3_align", f"SELECT session_id, tc, round({_held('click')}, 6) AS click, round({_held('purchase')}, 6) AS purchase FROM fx_samples WHERE channel IN ('click', 'purchase') WINDOW w AS (PARTITION BY session_id ORDER BY tc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def j3(spark, sf):
    return out(align.align(fx.samples(spark, sf), {"click": False, "purchase": False}))


@query("j4_assign_laps", "SELECT s.session_id, s.channel, s.tc, round(s.value, 6) AS value, l.lap_num FROM fx_samples s JOIN fx_laps l ON s.session_id = l.session_id AND s.tc >= l.start_tc AND s.tc < l.end_tc")
def j4(spark, sf):
    return out(align.assign_laps(fx.samples(spark, sf), fx.laps(spark, sf)).drop("start_tc", "end_tc"))


@query("p1_slice_lap", "SELECT s.session_id, s.channel, s.tc, round(s.value, 6) AS value, l.lap_num FROM fx_samples s JOIN fx_laps l ON s.session_id = l.session_id AND s.tc >= l.start_tc AND s.tc <= l.end_tc AND l.end_tc > l.start_tc")
def p1(spark, sf):
    return out(align.slice_lap(fx.samples(spark, sf), fx.laps(spark, sf)).drop("start_tc", "end_tc"))


@query("p2_slice_window", "SELECT s.session_id, s.channel, s.tc, l.lap_num, round(s.tc - l.start_tc - 500, 6) AS rel FROM fx_samples s JOIN fx_laps l ON s.session_id = l.session_id AND s.tc >= l.start_tc AND s.tc < l.end_tc WHERE s.tc - l.start_tc - 500 >= 1000 AND s.tc - l.start_tc - 500 < 60000")
def p2(spark, sf):
    return out(align.slice_window(fx.samples(spark, sf), fx.laps(spark, sf), 1000, 60000, 500).select("session_id", "channel", "tc", "lap_num", "rel"))


_BY_DIST = """
WITH s AS (SELECT x.session_id, x.channel, x.tc, l.lap_num, l.start_dist FROM fx_samples x JOIN fx_dlaps l ON x.session_id = l.session_id AND x.tc >= l.start_tc AND x.tc < l.end_tc),
d AS (
  SELECT s.*, CASE WHEN floor(s.tc / 1000) >= k_last THEN d_last ELSE a.dist + (s.tc / 1000 - floor(s.tc / 1000)) * (b.dist - a.dist) END AS dist
  FROM s JOIN fx_top USING (session_id)
  LEFT JOIN fx_dist a ON a.session_id = s.session_id AND a.k = CAST(floor(s.tc / 1000) AS BIGINT)
  LEFT JOIN fx_dist b ON b.session_id = s.session_id AND b.k = CAST(floor(s.tc / 1000) AS BIGINT) + 1)
SELECT session_id, channel, round(tc, 2) AS tc, lap_num, round(dist - start_dist, 2) + 0.0 AS rel FROM d WHERE dist - start_dist >= 1000 AND dist - start_dist < 60000"""


@query("p2_slice_distance", _BY_DIST)
def p2b(spark, sf):
    lp, m = fx.mapped_laps(spark, sf)
    own = distance.slice_distance(fx.samples(spark, sf), fx.kept(lp, "mapped_laps"), m, 1000, 60000, grid_ms=fx.GRID_MS)
    return out(own.select("session_id", "channel", "tc", "lap_num", "rel"), 2)


@query("p5_finite_channels", "SELECT session_id, channel, count(*) AS n FROM fx_samples GROUP BY ALL HAVING bool_and(value IS NOT NULL AND isfinite(value) AND value < 450)")
def p5(spark, sf):
    s = fx.samples(spark, sf).withColumn("value", F.when(F.col("value") < 450, F.col("value")).otherwise(float("inf")))
    return out(reports.finite_channels(s).groupBy("session_id", "channel").agg(F.count(F.lit(1)).alias("n")))


@query("p8_convert_units", "SELECT session_id, channel, 'mph' AS units, tc, round(value * (100 / 2.54 / 12 / 5280 * 3600 / 3.6), 6) AS value FROM fx_samples WHERE channel = 'click' UNION ALL SELECT session_id, channel, 'F' AS units, tc, round((value + 273.15) * 1.8 - 459.67, 6) FROM fx_samples WHERE channel = 'view'")
def p8(spark, sf):
    units = F.when(F.col("channel") == "click", "kph").when(F.col("channel") == "view", "c").otherwise("widgets")
    target = spark.createDataFrame([("click", "mph"), ("view", "F"), ("purchase", "m")], "channel string, to_units string")
    return out(convert_units(fx.samples(spark, sf).withColumn("units", units), F.broadcast(target)).select("session_id", "channel", "units", "tc", "value"))


@query("p9_comparable_units", "SELECT channel AS unit, other, count(*) AS n FROM fx_samples JOIN (VALUES ('click', 'click'), ('view', 'view'), ('purchase', 'purchase'), ('signup', 'signup')) t(unit, other) ON channel = t.unit GROUP BY ALL UNION ALL SELECT 'km/h', other, count(*) FROM fx_samples, (VALUES ('m/s'), ('km/h'), ('mph')) u(other) WHERE channel NOT IN ('click', 'view', 'purchase', 'signup') GROUP BY ALL")
def p9(spark, sf):
    unit = F.when(F.col("channel").isin("click", "view", "purchase", "signup"), F.col("channel")).otherwise("km/h")
    return out(comparable_units(fx.samples(spark, sf).select(unit.alias("unit"))).groupBy("unit", "other").agg(F.count(F.lit(1)).alias("n")))


@query("u1_timecode_union", "SELECT DISTINCT session_id, tc FROM fx_samples")
def u1(spark, sf):
    return out(align.timecode_union(fx.samples(spark, sf)))


@query("w1_build_dist_map", "SELECT session_id, k * 1000.0 AS tc, round(dist, 3) AS dist FROM fx_dist")
def w1(spark, sf):
    return out(distance.dist_grid(fx.dist_map(spark, sf), fx.GRID_MS), 3)


@query("j5_time_to_dist", "SELECT session_id, lap_num, round(start_dist, 3) AS start_dist, round(end_dist, 3) AS end_dist FROM fx_dlaps")
def j5(spark, sf):
    return out(fx.dist_laps(spark, sf).select("session_id", "lap_num", "start_dist", "end_dist"), 3)


_INV = """SELECT p.session_id, p.lap_num, p.dist, p.rel, a.k_hi AS k0, a.d_hi AS d0, b.k_lo AS k1, b.d_lo AS d1
FROM (SELECT l.session_id, l.lap_num, i * 20000.0 AS rel, start_dist + i * 20000.0 AS dist, round(start_dist + i * 20000.0, 6) AS at FROM fx_dlaps l, (SELECT unnest(range(0, 3)) AS i) WHERE round(start_dist + i * 20000.0, 6) < round(end_dist, 6)) p
ASOF LEFT JOIN fx_places a ON p.session_id = a.session_id AND p.at >= a.at
ASOF LEFT JOIN fx_places b ON p.session_id = b.session_id AND p.at < b.at"""


@query("j5_dist_to_time", f"SELECT session_id, lap_num, rel, round(CASE WHEN k0 IS NULL THEN 0.0 WHEN k1 IS NULL THEN k0 * 1000.0 ELSE (k0 + greatest(0, least(1, (dist - d0) / (d1 - d0)))) * 1000 END, 1) AS tc FROM ({_INV})")
def j5b(spark, sf):
    lp, m = fx.mapped_laps(spark, sf)
    p = lp.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("rel", F.col("i") * 20000.0).withColumn("dist", F.col("start_dist") + F.col("rel")).filter(distance.micrometres(F.col("dist")) < distance.micrometres(F.col("end_dist")))
    return out(distance.dist_to_time(p.select("session_id", "lap_num", "rel", "dist"), m, fx.GRID_MS).drop("dist"), 1)


@query("w2_laps_from_counter", "SELECT session_id, lap_num, round(start_tc, 6) AS start_tc, round(end_tc, 6) AS end_tc FROM fx_laps")
def w2(spark, sf):
    return out(fx.laps(spark, sf))


@query("a1_channel_stats", "SELECT session_id, channel, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value, count(value) AS n FROM fx_samples GROUP BY ALL")
def a1(spark, sf):
    return out(reports.channel_stats(fx.samples(spark, sf)))


_ONE = "(SELECT session_id, min(lap_num) AS ref_num FROM fx_laps GROUP BY session_id)"
_LS = "(SELECT l.session_id, l.lap_num, s.channel, min(value) AS lo, max(value) AS hi, count(*) AS n FROM fx_samples s JOIN fx_laps l ON s.session_id = l.session_id AND s.tc >= l.start_tc AND s.tc < l.end_tc GROUP BY ALL)"


@query("a2_lap_stats", f"SELECT a.session_id, a.lap_num, a.channel, round(a.lo, 6) AS min_value, round(a.hi, 6) AS max_value, a.n, round(a.lo - b.lo, 6) AS min_delta, round(a.hi - b.hi, 6) AS max_delta FROM {_LS} a LEFT JOIN (SELECT x.* FROM {_LS} x JOIN {_ONE} r ON x.session_id = r.session_id AND x.lap_num = r.ref_num) b ON a.session_id = b.session_id AND a.channel = b.channel")
def a2(spark, sf):
    lp = fx.laps(spark, sf)
    return out(laps.lap_stats(fx.samples(spark, sf), lp, lp.groupBy("session_id").agg(F.min("lap_num").alias("lap_num"))))


_W = "(SELECT *, lead(tc) OVER (PARTITION BY session_id, channel ORDER BY tc) - tc AS weight FROM fx_samples)"


@query(
    "a3_weighted_histogram",
    f"""WITH w AS (SELECT s.* FROM {_W} s JOIN fx_laps l ON s.session_id = l.session_id AND s.tc >= l.start_tc AND s.tc < l.end_tc WHERE weight IS NOT NULL),
e AS (SELECT min(value) AS lo, max(value) AS hi FROM w),
b AS (SELECT channel, CAST(least(29, floor((value - lo) * 30 / (hi - lo))) AS BIGINT) AS bin, sum(weight) AS weight, any_value(lo) AS lo, any_value(hi) AS hi FROM w, e GROUP BY ALL),
p AS (SELECT *, 100 * weight / sum(weight) OVER (PARTITION BY channel) AS percent FROM b)
SELECT channel, bin, round(lo + bin * (hi - lo) / 30, 6) AS edge, round(percent, 6) AS percent, round(sum(percent) OVER (PARTITION BY channel ORDER BY bin), 6) AS cumulative FROM p""",
)
def a3(spark, sf):
    return out(reports.weighted_histogram(fx.samples(spark, sf), fx.laps(spark, sf)))


@query("a4_table2d", "SELECT round_even(l_quantity / 5, 0) * 5 AS x_cell, round(round_even(l_discount / 0.02, 0) * 0.02, 6) AS y_cell, round(avg(l_extendedprice), 4) AS mean_value, count(l_extendedprice) AS n FROM lineitem WHERE abs(l_quantity - round_even(l_quantity / 5, 0) * 5) / 5 < 0.3 AND abs(l_discount - round_even(l_discount / 0.02, 0) * 0.02) / 0.02 < 0.3 GROUP BY ALL")
def a4(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(*[F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_extendedprice")])
    t = reports.table2d(rows, "l_quantity", "l_discount", "l_extendedprice", 5.0, 0.02, 30.0)
    return t.select(F.round("x_cell", 6).alias("x_cell"), F.round("y_cell", 6).alias("y_cell"), F.round("mean_value", 4).alias("mean_value"), "n")


@query("u3_axis_values", "SELECT DISTINCT 'x' AS axis, round_even(l_quantity / 5, 0) * 5 AS cell FROM lineitem WHERE abs(l_quantity - round_even(l_quantity / 5, 0) * 5) / 5 < 0.5 UNION SELECT DISTINCT 'y', 0.0 FROM lineitem")
def u3(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(*[F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice")])
    return out(reports.axis_values(reports.table2d(rows, "l_quantity", None, "l_extendedprice", 5.0)))


_DUR = "(SELECT *, end_tc - start_tc AS dur, end_dist - start_dist AS dist, row_number() OVER (PARTITION BY session_id ORDER BY lap_num) AS i, count(*) OVER (PARTITION BY session_id) AS n FROM fx_dlaps)"
_BEST = f"(SELECT session_id, lap_num, start_tc, end_tc, start_dist, end_dist, dur FROM (SELECT x.*, row_number() OVER (PARTITION BY session_id ORDER BY dur, lap_num) AS r FROM (SELECT d.*, median(dist) OVER (PARTITION BY session_id) AS med FROM {_DUR} d WHERE n <= 2 OR (i > 1 AND i < n)) x WHERE n <= 2 OR dist >= 0.95 * med) WHERE r = 1)"


#: The same with distances in micrometres, as best_lap compares them.
_BEST_UM = _BEST.replace("d.*, median(dist) OVER (PARTITION BY session_id) AS med FROM", "d.* REPLACE (round(dist, 6) AS dist), median(round(dist, 6)) OVER (PARTITION BY session_id) AS med FROM")


@query("a5_lap_distances", f"SELECT d.session_id, lap_num, round(dist, 3) AS dist, round(med, 3) AS median_dist FROM {_DUR} d LEFT JOIN (SELECT session_id, median(dist) AS med FROM {_DUR} WHERE i > 1 AND i < n GROUP BY session_id) USING (session_id)")
def a5(spark, sf):
    return out(laps.lap_distances(fx.dist_laps(spark, sf)), 3)


@query("a6_best_lap", f"SELECT session_id, lap_num, round(start_tc, 6) AS start_tc, round(end_tc, 6) AS end_tc, round(dur, 6) AS duration FROM {_BEST_UM}")
def a6(spark, sf):
    return out(laps.best_lap(fx.dist_laps(spark, sf)))


@query("o2_top_laps", "SELECT session_id, lap_num, round(end_tc - start_tc, 6) AS duration, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY end_tc - start_tc, lap_num) AS rank FROM fx_laps) WHERE rank <= 3")
def o2(spark, sf):
    return out(laps.top_laps(fx.laps(spark, sf)))


@query("w11_lap_table", f"SELECT l.session_id, l.lap_num, round(l.start_tc, 6) AS start_tc, round(l.end_tc - l.start_tc, 6) AS duration, round(l.end_tc - l.start_tc - b.dur, 6) AS delta, round(l.end_tc - l.start_tc - (SELECT min(dur) FROM {_BEST}), 6) AS fleet_delta, l.lap_num = b.lap_num AS is_best FROM fx_dlaps l LEFT JOIN {_BEST} b ON l.session_id = b.session_id")
def w11(spark, sf):
    lp = fx.kept(fx.dist_laps(spark, sf), "mapped_laps")
    return out(laps.lap_table(lp, laps.best_lap(lp)))


_SLIP = f"""WITH pts AS (
SELECT l.session_id, l.lap_num, b.lap_num AS ref_num, i * 50000.0 AS rel, side, CASE side WHEN 'own' THEN l.start_tc ELSE b.start_tc END AS t0, i * 50000.0 + CASE side WHEN 'own' THEN l.start_dist ELSE b.start_dist END AS dist
FROM fx_dlaps l JOIN {_BEST_UM} b ON l.session_id = b.session_id, LATERAL (SELECT unnest(range(0, CAST(floor(round(b.end_dist - b.start_dist, 6) / 50000) AS BIGINT) + 1)) AS i), (VALUES ('own'), ('ref')) s(side)),
inv AS (SELECT p.*, a.k_hi AS k0, a.d_hi AS d0, n.k_lo AS k1, n.d_lo AS d1 FROM (SELECT *, round(dist, 6) AS at FROM pts) p ASOF LEFT JOIN fx_places a ON p.session_id = a.session_id AND p.at >= a.at ASOF LEFT JOIN fx_places n ON p.session_id = n.session_id AND p.at < n.at),
t AS (SELECT session_id, lap_num, ref_num, rel, side, CASE WHEN k0 IS NULL THEN 0.0 WHEN k1 IS NULL THEN k0 * 1000.0 ELSE (k0 + greatest(0, least(1, (dist - d0) / (d1 - d0)))) * 1000 END - t0 AS t FROM inv)
SELECT session_id, lap_num, rel, round(CASE WHEN lap_num <> ref_num THEN (max(t) FILTER (side = 'own') - max(t) FILTER (side = 'ref')) / 1000 END, 3) + 0.0 AS slip_s FROM t GROUP BY session_id, lap_num, ref_num, rel"""


@query("j6_time_slip", _SLIP)
def j6(spark, sf):
    lp, m = fx.mapped_laps(spark, sf)
    lp = fx.kept(lp, "mapped_laps")
    best = laps.best_lap(lp).select("session_id", "lap_num").join(lp, ["session_id", "lap_num"])
    return out(distance.time_slip(lp, best, m, 50000, fx.GRID_MS), 3)


@query("a8_downsample_minmax", "WITH b AS (SELECT session_id, channel, CAST(round_even(tc * 0.00001, 0) AS BIGINT) AS bucket, min(value) AS lo, max(value) AS hi, arg_min(value, tc) AS f, arg_max(value, tc) AS l FROM fx_samples GROUP BY ALL), h AS (SELECT *, lag(l) OVER (PARTITION BY session_id, channel ORDER BY bucket) AS p FROM b) SELECT session_id, channel, bucket, round(least(lo, coalesce(p, lo)), 6) AS min_value, round(greatest(hi, coalesce(p, hi)), 6) AS max_value, round(f, 6) AS first_value, round(l, 6) AS last_value FROM h")
def a8(spark, sf):
    return out(reports.downsample_minmax(fx.samples(spark, sf), 0.00001, hold=True))


@query("a11_axis_ranges", "WITH r AS (SELECT channel, min(value) AS a, max(value) AS b FROM fx_samples s JOIN fx_laps l ON s.session_id = l.session_id AND s.tc >= l.start_tc AND s.tc < l.end_tc GROUP BY channel) SELECT channel, round(a - CASE WHEN a = b THEN 1 ELSE (b - a) * 0.03 END, 6) AS lo, round(b + CASE WHEN a = b THEN 1 ELSE (b - a) * 0.03 END, 6) AS hi FROM r")
def a11(spark, sf):
    return out(reports.axis_ranges(fx.samples(spark, sf), fx.laps(spark, sf)))


@query("a10_robust_offset", "WITH o AS (SELECT session_id, value AS x, row_number() OVER (PARTITION BY session_id ORDER BY value) AS i, count(*) OVER (PARTITION BY session_id) AS n FROM fx_samples WHERE channel = 'view'), m AS (SELECT session_id, x AS med FROM o WHERE i = n // 2 + 1) SELECT session_id, round(avg(x), 6) AS \"offset\" FROM o JOIN m USING (session_id) WHERE abs(x - med) <= 10 GROUP BY session_id")
def a10(spark, sf):
    return out(reports.robust_offset(fx.samples(spark, sf).filter("channel = 'view'").select("session_id", F.col("value").alias("offset"))))
