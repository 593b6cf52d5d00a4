"""Queries for normalisation, positions, sources, catalog, derived channels and streams, with their SQL."""

from __future__ import annotations

import math
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import align, derive, distance, laps, normalize, reports, tracks
from ..sources import catalog, storage, text_logs
from ..sources.storage import scratch
from ..streaming import jobs
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


# Normalisation -----------------------------------------------------------------------------------


@query("n1_unwrap_counter", "SELECT session_id, channel, round(tc, 3) AS tc FROM (SELECT session_id, channel, floor(tc * 4) / 4 AS tc FROM fx_samples) WHERE tc IS NOT NULL")
def n1(spark, sf):
    # A counter of quarter units that wraps at 65536 units; gaps between samples of a session are shorter.
    s = fx.samples(spark, sf).withColumn("q", F.floor(F.col("tc") * 4) / 4)
    s = s.withColumn("raw", F.pmod(F.col("q"), F.lit(4_194_304.0)))
    return out(normalize.unwrap_counter(s.drop("tc"), "raw", 4_194_304.0, "q").select("session_id", "channel", "tc"), 3)


@query("n2_drop_replayed", "WITH r AS (SELECT session_id, channel, event_id, floor(value) AS tc, max(floor(value)) OVER (PARTITION BY session_id, channel ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ev) SELECT session_id, channel, event_id, tc FROM r WHERE top IS NULL OR tc > top")
def n2(spark, sf):
    s = fx.events(spark, sf).select("session_id", "channel", "event_id", F.floor("value").cast("double").alias("tc"))
    return out(normalize.drop_replayed(s, "event_id"))


@query("n3_explode_batches", "SELECT session_id, channel, round(tc + i * 0.5, 6) AS tc, round(value + i, 6) AS value FROM fx_samples, (SELECT unnest(range(0, 3)) AS i)")
def n3(spark, sf):
    b = fx.samples(spark, sf).select("session_id", "channel", "tc", F.array("value", F.col("value") + 1, F.col("value") + 2).alias("values"))
    return out(normalize.explode_batches(b, 0.5))


@query("n4_asof_clock", "WITH c AS (SELECT session_id, event_id, tc FROM ev WHERE channel = 'view'), m AS (SELECT session_id, event_id FROM ev WHERE channel = 'click'), f AS (SELECT session_id, arg_min(tc, event_id) AS first_tc FROM c GROUP BY session_id) SELECT m.session_id, m.event_id AS seq, coalesce(c.tc, f.first_tc) AS tc FROM m ASOF LEFT JOIN c ON m.session_id = c.session_id AND m.event_id > c.event_id LEFT JOIN f ON m.session_id = f.session_id")
def n4(spark, sf):
    e = fx.events(spark, sf).withColumnRenamed("event_id", "seq")
    return out(normalize.asof_clock(e.filter("channel = 'click'").select("session_id", "seq"), e.filter("channel = 'view'").select("session_id", "seq", "tc")))


@query("n5_map_clock", "SELECT session_id, event_id, round(least(greatest(CASE WHEN session_id % 2 = 0 THEN tc ELSE tc END, lo), CASE WHEN session_id % 2 = 0 THEN hi ELSE tc END), 1) AS tc FROM ev JOIN (SELECT session_id, min(tc) AS lo, max(tc) AS hi FROM ev GROUP BY session_id) USING (session_id)")
def n5(spark, sf):
    e = fx.events(spark, sf).select("session_id", "event_id", "tc")
    ends = e.groupBy("session_id").agg(F.min("tc").alias("lo"), F.max("tc").alias("hi"))
    pairs = ends.select("session_id", F.explode(F.array("lo", "hi")).alias("tc")).withColumn("gps_tc", F.col("tc") * 2 + 1e9)
    gps = e.withColumn("tc", F.when(F.col("session_id") % 2 == 0, F.col("tc") * 2 + 1e9).otherwise(F.col("tc")))
    return out(normalize.map_clock(gps, pairs), 1)


@query("n6_split_subchannels", "SELECT session_id, CASE event_id % 7 WHEN 0 THEN 'oil' WHEN 3 THEN 'water' ELSE 'id ' || (event_id % 7) END AS channel, tc, round(value, 6) AS value FROM ev")
def n6(spark, sf):
    names = spark.createDataFrame([(0, "oil"), (3, "water")], "id long, name string")
    return out(normalize.split_subchannels(fx.events(spark, sf).select("session_id", "tc", (F.col("event_id") % 7).alias("id"), "value"), names))


@query("n7_explode_array_channel", "SELECT session_id, channel || '[' || (i + 1) || ']' AS channel, tc, round(value * (i + 1), 6) AS value FROM fx_samples, (SELECT unnest(range(0, 4)) AS i)")
def n7(spark, sf):
    return out(normalize.explode_array_channel(fx.samples(spark, sf).select("session_id", "channel", "tc", F.array(*[F.col("value") * k for k in (1, 2, 3, 4)]).alias("values"))))


@query("n8_apply_calibration", "SELECT session_id, channel, tc, round(CASE channel WHEN 'click' THEN value * 3 / (2 * 100) + 7 WHEN 'view' THEN (value + 5) * 0.25 WHEN 'signup' THEN value / 8 + 1.5 ELSE value END, 6) AS value FROM fx_samples")
def n8(spark, sf):
    defs = spark.createDataFrame([("click", "motec", 3.0, 2.0, 2.0, 7.0), ("view", "linear", 5.0, 0.25, 0.0, 0.0), ("signup", "scaled", 1.5, 8.0, 0.0, 0.0)], "channel string, form string, p double, q double, r double, s double")
    return out(normalize.apply_calibration(fx.samples(spark, sf), defs).select("session_id", "channel", "tc", "value"))


@query("n9_fix_units", "SELECT session_id, channel, tc, round(CASE channel WHEN 'click' THEN value * 100 WHEN 'view' THEN value * 0.001 ELSE value END, 6) AS value FROM fx_samples")
def n9(spark, sf):
    units = F.when(F.col("channel") == "click", "%").when(F.col("channel") == "view", "V").otherwise("m")
    return out(normalize.fix_units(fx.samples(spark, sf).withColumn("units", units), [("%", 100.0), ("V", 0.001)]).drop("units"))


@query("n10_decode_enum", "SELECT session_id, channel, tc, CASE WHEN (CAST(floor(value * 4096) AS BIGINT) & 524288) <> 0 THEN 0.0 ELSE CAST((CAST(floor(value * 4096) AS BIGINT) >> 16) & 7 AS DOUBLE) END AS value FROM fx_samples")
def n10(spark, sf):
    return out(normalize.decode_gear_bits(fx.samples(spark, sf).withColumn("value", F.floor(F.col("value") * 4096))))


@query("n10_decode_map", "SELECT session_id, channel, tc, CASE CAST(floor(value) AS BIGINT) % 10 WHEN 1 THEN 10.0 WHEN 2 THEN 20.0 WHEN 3 THEN -1.0 END AS value FROM fx_samples")
def n10b(spark, sf):
    return out(normalize.decode_enum(fx.samples(spark, sf).withColumn("value", F.floor("value") % 10), {1: 10, 2: 20, 3: -1}))


@query("n11_drop_gps_sentinels", "SELECT session_id, channel, tc FROM (SELECT DISTINCT session_id, tc FROM fx_fixes), (VALUES ('lat'), ('lon'), ('alt')) c(channel) WHERE CAST(tc AS BIGINT) % 7000 <> 0")
def n11(spark, sf):
    f = fx.fixes(spark, sf)
    zero = F.col("tc") % 7000 == 0
    f = f.withColumn("lat", F.when(zero, 0.0).otherwise(F.col("lat"))).withColumn("lon", F.when(zero, 0.0).otherwise(F.col("lon")))
    s = f.unpivot(["session_id", "tc"], ["lat", "lon", "alt"], "channel", "value")
    return out(normalize.drop_gps_sentinels(s, "lat", "lon", "alt").select("session_id", "channel", "tc"))


@query("n13_ecef_round_trip", "SELECT session_id, tc, channel, round(CASE channel WHEN 'lat' THEN lat WHEN 'lon' THEN lon WHEN 'alt' THEN 0.0 ELSE 13.0 END, 5) + 0.0 AS value FROM fx_fixes, (VALUES ('lat'), ('lon'), ('alt'), ('speed')) c(channel)")
def n13(spark, sf):
    f = fx.fixes(spark, sf)
    xyz = geo.lla_to_ecef(F.col("lat"), F.col("lon"), F.col("alt"))
    f = f.select("session_id", "tc", *[(c * 100).alias(f"ecef_{n}") for n, c in zip("xyz", xyz, strict=True)], F.lit(300.0).alias("ecef_dx"), F.lit(400.0).alias("ecef_dy"), F.lit(1200.0).alias("ecef_dz"))
    s = f.unpivot(["session_id", "tc"], [c for c in f.columns if c.startswith("ecef")], "channel", "value")
    return out(normalize.ecef_to_lla(s), 5)


@query("n14_rebase_time", "SELECT session_id, channel, round(tc - min(tc) OVER (PARTITION BY session_id), 6) + 0.0 AS tc FROM fx_samples")
def n14(spark, sf):
    return out(normalize.rebase_time(fx.samples(spark, sf)).select("session_id", "channel", "tc"))


@query("n15_repair_timecode", "WITH s AS (SELECT session_id, event_id, floor(tc) AS tc FROM ev), r AS (SELECT a.session_id, a.event_id AS seq, CAST(a.tc AS BIGINT) % 16384 AS raw, CAST(coalesce(b.tc, first_value(a.tc) OVER (PARTITION BY a.session_id ORDER BY a.event_id)) AS BIGINT) AS now FROM s a ASOF LEFT JOIN s b ON a.session_id = b.session_id AND a.event_id > b.event_id), d AS (SELECT *, ((raw - now) % 16384 + 16384) % 16384 AS diff FROM r) SELECT session_id, seq, raw, CAST(now + CASE WHEN diff >= 8192 THEN diff - 16384 ELSE diff END AS DOUBLE) AS tc FROM d")
def n15(spark, sf):
    e = fx.events(spark, sf).select("session_id", F.col("event_id").alias("seq"), F.floor("tc").cast("double").alias("tc"))
    return out(normalize.repair_timecode(e.select("session_id", "seq", (F.col("tc").cast("long") % 16384).alias("raw")), e))


# Positions ---------------------------------------------------------------------------------------

_N = "6378137.0 / sqrt(1 - e2 * sin(radians(lat)) * sin(radians(lat)))"
_ECEF = f"(SELECT session_id, tc, lat, lon, {_N} * cos(radians(lat)) * cos(radians(lon)) AS x, {_N} * cos(radians(lat)) * sin(radians(lon)) AS y, {_N} * (1 - e2) * sin(radians(lat)) AS z FROM fx_fixes, (SELECT (1 / 298.257223563) * (2 - 1 / 298.257223563) AS e2))"


@query("f7_lla_to_ecef", f"SELECT session_id, tc, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM {_ECEF}")
def f7(spark, sf):
    f = fx.fixes(spark, sf)
    return out(f.select("session_id", "tc", *[c.alias(n) for n, c in zip("xyz", geo.lla_to_ecef(F.col("lat"), F.col("lon"), F.col("alt")), strict=True)]), 4)


@query("f9_bearing", "WITH n AS (SELECT *, lead(lat) OVER w AS lat1, lead(lon) OVER w AS lon1 FROM fx_fixes WINDOW w AS (PARTITION BY session_id ORDER BY tc)) SELECT session_id, tc, round(degrees(atan2(sin(radians(lon1 - lon)) * cos(radians(lat1)), cos(radians(lat)) * sin(radians(lat1)) - sin(radians(lat)) * cos(radians(lat1)) * cos(radians(lon1 - lon)))), 6) AS brg, CAST(floor((lat + 180) * 1296 / 360) AS BIGINT) AS cy, CAST(floor((lon + 180) * 1296 / 360) AS BIGINT) AS cx FROM n WHERE lat1 IS NOT NULL")
def f9(spark, sf):
    w = Window.partitionBy("session_id").orderBy("tc")
    f = fx.fixes(spark, sf).withColumn("lat1", F.lead("lat").over(w)).withColumn("lon1", F.lead("lon").over(w)).filter("lat1 IS NOT NULL")
    return out(f.select("session_id", "tc", geo.bearing(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1")).alias("brg"), geo.cell(F.col("lat")).alias("cy"), geo.cell(F.col("lon")).alias("cx")))


@query("a13_start_line", "SELECT session_id, round(median(lat), 6) AS lat, round(median(lon), 6) AS lon FROM fx_fixes GROUP BY session_id")
def a13(spark, sf):
    s = fx.fixes(spark, sf).unpivot(["session_id", "tc"], ["lat", "lon"], "channel", "value")
    return out(tracks.start_line(s, "lat", "lon"))


@query("a14_path_bounds", "SELECT session_id, round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat, round(min(lon), 6) AS min_lon, round(max(lon), 6) AS max_lon, 0.0 AS min_alt, 0.0 AS max_alt FROM fx_fixes GROUP BY session_id")
def a14(spark, sf):
    return out(tracks.path_bounds(fx.fixes(spark, sf)))


@query("a15_tile_rollup", "SELECT CAST(floor((lon + 180) / 360 * 65536) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 65536) AS BIGINT) AS y, count(*) AS n, 16 AS zoom FROM fx_fixes GROUP BY 1, 2")
def a15(spark, sf):
    return tracks.tile_rollup(fx.fixes(spark, sf), 16)


_LINE = "(SELECT 45.0 AS slat, 9.006 AS slon)"
# Crossings restated with plain algebra; every session of the fixture moves faster than 4 m/s.
_CROSS = f"""WITH k AS (SELECT (1 / 298.257223563) * (2 - 1 / 298.257223563) AS e2),
s AS (SELECT n * cos(radians(slat)) * cos(radians(slon)) AS sx, n * cos(radians(slat)) * sin(radians(slon)) AS sy, n * (1 - e2) * sin(radians(slat)) AS sz, 1000 * cos(radians(slat)) * cos(radians(slon)) AS ux, 1000 * cos(radians(slat)) * sin(radians(slon)) AS uy, 1000 * sin(radians(slat)) AS uz FROM (SELECT *, 6378137.0 / sqrt(1 - e2 * sin(radians(slat)) * sin(radians(slat))) AS n FROM {_LINE}, k)),
o AS (SELECT session_id, tc, x - sx AS ox, y - sy AS oy, z - sz AS oz, ux, uy, uz FROM {_ECEF}, s),
d AS (SELECT *, lead(tc) OVER w AS tc1, lead(ox) OVER w - ox AS dx, lead(oy) OVER w - oy AS dy, lead(oz) OVER w - oz AS dz FROM o WINDOW w AS (PARTITION BY session_id ORDER BY tc)),
n AS (SELECT *, (ux*ux+uy*uy+uz*uz) AS uu, (ux*dx+uy*dy+uz*dz) AS ud FROM d WHERE tc1 IS NOT NULL),
n2 AS (SELECT *, uu*dx - ud*ux AS nx, uu*dy - ud*uy AS ny, uu*dz - ud*uz AS nz FROM n),
t1 AS (SELECT *, greatest(-(nx*ox+ny*oy+nz*oz) / (nx*dx+ny*dy+nz*dz), 0) AS t FROM n2),
p1 AS (SELECT * FROM (SELECT *, lag(t) OVER (PARTITION BY session_id ORDER BY tc) AS t0 FROM t1) WHERE t <= 1 AND t0 > 1 AND (ox+t*dx)*(ox+t*dx)+(oy+t*dy)*(oy+t*dy)+(oz+t*dz)*(oz+t*dz) < 900),
m AS (SELECT session_id, sum(nx) AS mx, sum(ny) AS my, sum(nz) AS mz FROM p1 WHERE dx*dx+dy*dy+dz*dz > 16 GROUP BY session_id),
t2 AS (SELECT n2.*, greatest(-(mx*ox+my*oy+mz*oz) / (mx*dx+my*dy+mz*dz), 0) AS t FROM n2 JOIN m USING (session_id)),
p2 AS (SELECT * FROM (SELECT *, lag(t) OVER (PARTITION BY session_id ORDER BY tc) AS t0 FROM t2) WHERE t <= 1 AND t0 > 1 AND (ox+t*dx)*(ox+t*dx)+(oy+t*dy)*(oy+t*dy)+(oz+t*dz)*(oz+t*dz) < 900)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY tc) - 1 AS crossing, round(tc + t * (tc1 - tc), 2) AS tc FROM p2"""


def _line(spark, sf):
    return fx.table(spark, sf, "events").select(F.col("user_id").alias("session_id")).distinct().withColumn("lat", F.lit(45.0)).withColumn("lon", F.lit(9.006))


@query("w6_line_crossings", _CROSS)
def w6(spark, sf):
    return out(tracks.line_crossings(fx.fixes(spark, sf), _line(spark, sf)), 2)


@query("w6_laps_from_gps", f"SELECT session_id, count(*) + 1 AS n, round(max(tc), 1) AS last_start FROM ({_CROSS}) GROUP BY session_id")
def w6b(spark, sf):
    x = tracks.laps_from_gps(fx.fixes(spark, sf), _line(spark, sf))
    return out(x.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max("start_tc").alias("last_start")), 1)


@query("w13_reinsert_laps", f"SELECT session_id, lap_num, round(start_tc, 1) + 0.0 AS start_tc, round(end_tc, 1) AS end_tc FROM (SELECT session_id, row_number() OVER w - 1 AS lap_num, tc AS start_tc, lead(tc) OVER w AS end_tc FROM (SELECT session_id, tc FROM ({_CROSS}) UNION ALL SELECT DISTINCT session_id, 0.0 FROM fx_fixes UNION ALL SELECT session_id, max(tc) FROM fx_fixes GROUP BY session_id) WINDOW w AS (PARTITION BY session_id ORDER BY tc)) WHERE end_tc IS NOT NULL")
def w13(spark, sf):
    line = _line(spark, sf)
    cut, _ = tracks.reinsert_laps(fx.fixes(spark, sf), fx.speed(spark, sf), line, line.select("session_id", F.lit(1000.0).alias("length")))
    return out(cut, 1)


def _map_sql(laps_sql: str, lengths: str) -> str:
    """The literal grid of a distance map over other laps (session_id, lap_num, start_tc, end_tc), inner ones scaled to ``lengths`` (session_id, length)."""
    steps = ("fx_gridlaps", "fx_kend", "fx_points", "fx_prev", "fx_next", "fx_grid", "fx_len")
    own = {"fx_laps": "gx_laps", **{n: "g" + n[1:] for n in (*steps, "fx_factor", "fx_dist")}}
    renamed = lambda text: re.sub(r"\bfx_\w+", lambda m: own.get(m[0], m[0]), text)
    views = [f"gx_laps AS ({laps_sql})", *[f"{own[n]} AS ({renamed(fx.VIEWS[n])})" for n in steps]]
    views.append(f"gx_factor AS (SELECT session_id, lap_num, CASE WHEN abs(len - length) / length <= 0.05 THEN length / len ELSE 1.0 END AS factor FROM gx_len JOIN ({lengths}) USING (session_id))")
    views.append(f"gx_dist AS ({renamed(fx.VIEWS['fx_dist'])})")
    return "WITH " + ", ".join(views)


_RECUT = f"SELECT session_id, row_number() OVER w - 1 AS lap_num, tc AS start_tc, lead(tc) OVER w AS end_tc FROM (SELECT session_id, tc FROM ({_CROSS}) UNION ALL SELECT DISTINCT session_id, 0.0 FROM fx_fixes UNION ALL SELECT session_id, max(tc) FROM fx_fixes GROUP BY session_id) WINDOW w AS (PARTITION BY session_id ORDER BY tc) QUALIFY lead(tc) OVER w IS NOT NULL"


@query("w13_rescaled_map", _map_sql(_RECUT, "SELECT session_id, avg(value) * 62 AS length FROM fx_speed GROUP BY session_id") + " SELECT session_id, k * 1000.0 AS tc, round(dist, 3) AS dist FROM gx_dist")
def w13b(spark, sf):
    # Laps cut again at the line, and those near the track's length scaled to it.
    line, speed = _line(spark, sf), fx.speed(spark, sf)
    length = speed.groupBy("session_id").agg((F.avg("value") * 62).alias("length"))
    cut, found = tracks.reinsert_laps(fx.fixes(spark, sf), speed, line, length, fx.GRID_MS)
    return out(distance.dist_grid(found, fx.GRID_MS), 3)


@query("w10_build_track")
def w10(spark, sf):
    # Laps between crossings of the start line; speed is the way from fix to fix.
    fixes = fx.fixes(spark, sf)
    lp = fx.kept(tracks.laps_from_gps(fixes, _line(spark, sf)), "gps_laps")
    w = Window.partitionBy("session_id").orderBy("tc")
    dy, dx = (F.lead("lat").over(w) - F.col("lat")) * 111_195, (F.lead("lon").over(w) - F.col("lon")) * 78_627
    moved = fixes.withColumn("speed", F.coalesce(F.sqrt(dy * dy + dx * dx), F.lit(30.0)))
    m = fx.kept(distance.build_dist_map(moved.select("session_id", "tc", F.col("speed").alias("value")), lp, fx.GRID_MS), "gps_map")
    s = moved.unpivot(["session_id", "tc"], ["lat", "lon", "speed"], "channel", "value")
    # Not written: a path is made again of its pieces, which are far fewer than its places.
    path = tracks.best_lap_path(s, distance.with_lap_distances(lp, m, fx.GRID_MS), m, "lat", "lon", "speed", grid_ms=fx.GRID_MS)
    points, parts = tracks.build_track(path, limit=40.0)
    return out(points.groupBy("track_id").agg(F.count(F.lit(1)).alias("points")).join(parts.groupBy("track_id").agg(F.count(F.lit(1)).alias("parts"), F.max("dist").alias("last_dist")), "track_id"), 3)


# Turn rates made of values, so that runs are short and every rule of merging is met.
_RATES = "(SELECT session_id AS track_id, row_number() OVER (PARTITION BY session_id ORDER BY tc, event_id) - 1 AS seq, (CAST(floor(value * 100) AS BIGINT) % 100 - 50) * 8.0 AS rate FROM ev)"


def _runs_sql(rates: str) -> str:
    """Runs of rates (track_id, seq, rate) as a list for each track."""
    return f"""
rates AS (SELECT *, CASE WHEN rate > 150 THEN 'R' WHEN rate < -150 THEN 'L' ELSE 'S' END AS kind FROM {rates} WHERE rate IS NOT NULL),
marked AS (
  SELECT *, coalesce(kind <> lag(kind) OVER w, true) AS fresh, (rate > 0) <> (lag(rate) OVER w > 0) AS turned
  FROM rates WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
counted AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY track_id ORDER BY seq) AS run FROM marked),
runs AS (
  SELECT track_id, run, any_value(kind) AS kind, min(seq)::BIGINT AS a, max(seq)::BIGINT + 1 AS b,
         (min(seq) FILTER (turned AND NOT fresh))::BIGINT AS crossing
  FROM counted GROUP BY track_id, run),
lists AS (SELECT track_id, list({{'kind': kind, 'a': a, 'b': b, 'crossing': crossing}} ORDER BY run) AS r FROM runs GROUP BY track_id)"""


def _sql_fold(name: str, source: str, one: str, meet: str) -> str:
    """A recursive query that merges the runs of ``source`` from the last to the first; a step takes run i (from 1)."""
    own = "{'kind': r[i].kind, 'a': r[i].a, 'b': coalesce(upto, r[i].b), 'crossing': r[i].crossing}"
    moved = f"{{'kind': done[1].kind, 'a': {meet}, 'b': done[1].b, 'crossing': done[1].crossing}}"
    inner = "i > 2 AND len(done) > 0"
    return f"""
{name} AS (
  SELECT track_id, r, len(r) AS i, r[1:0] AS done, CAST(NULL AS BIGINT) AS upto FROM {source}
  UNION ALL
  SELECT track_id, r, i - 1,
         CASE WHEN {inner} AND ({one}) THEN done[2:] WHEN {inner} AND ({meet}) IS NOT NULL THEN list_concat([{moved}], done[2:]) ELSE list_concat([{own}], done) END,
         CASE WHEN {inner} AND ({one}) THEN done[1].b WHEN {inner} AND ({meet}) IS NOT NULL THEN {meet} END
  FROM {name} WHERE i > 0)"""


def _segments_sql(rates: str, spacing: float) -> str:
    """Segments of tracks: runs merged by two recursive queries, then named."""
    long = f"(coalesce(upto, r[i].b) - r[i].a) * {spacing}"
    short = f"r[i].kind = 'S' AND {long} < 25"
    folds = [
        _sql_fold("straight", "lists", f"{short} AND r[i - 1].kind = done[1].kind", f"CASE WHEN {short} THEN r[i].crossing END"),
        " merged AS (SELECT track_id, done AS r FROM straight WHERE i = 0)",
        _sql_fold("turned_once", "merged", f"r[i].kind <> 'S' AND {long} < 10", "CAST(NULL AS BIGINT)"),
    ]
    return f"""WITH RECURSIVE {_runs_sql(rates)}, {",".join(folds)},
parts AS (SELECT track_id, done, generate_subscripts(done, 1) AS i FROM turned_once WHERE i = 0),
named AS (
  SELECT track_id, i, done[i] AS own, count(*) FILTER (done[i].kind <> 'S') OVER (PARTITION BY track_id) AS total,
         coalesce(count(*) FILTER (done[i].kind <> 'S') OVER (PARTITION BY track_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn
  FROM parts)
SELECT track_id, i - 1 AS seg, own.a AS start_seq, own.b AS end_seq,
       CASE own.kind WHEN 'R' THEN 'Right' WHEN 'L' THEN 'Left' ELSE 'Straight' END AS kind,
       CASE WHEN own.kind <> 'S' THEN 'Turn ' || (turn + 1) ELSE 'Str ' || (CASE WHEN turn > 0 THEN turn ELSE total END) || '-' || (turn % greatest(total, 1) + 1) END AS name
FROM named"""


@query("w9_merge_segments", _segments_sql(_RATES, 4.0))
def w9b(spark, sf):
    w = Window.partitionBy("session_id").orderBy("tc", "event_id")
    e = fx.events(spark, sf)
    rate = (F.pmod(F.floor(F.col("value") * 100).cast("long"), F.lit(100)) - 50) * 8.0
    turns = e.select(F.col("session_id").alias("track_id"), (F.row_number().over(w) - 1).cast("long").alias("seq"), rate.alias("rate"))
    return tracks.segment_track(turns, spacing_m=4.0)


@query("o3_markers_by_distance", "SELECT track_id, name, row_number() OVER (PARTITION BY track_id ORDER BY coalesce(dist, 0), name) AS place FROM (SELECT session_id % 7 AS track_id, channel || '_' || session_id AS name, CASE WHEN channel <> 'error' THEN min(value) END AS dist FROM fx_samples GROUP BY session_id, channel)")
def o3(spark, sf):
    m = fx.samples(spark, sf).groupBy("session_id", "channel").agg(F.min("value").alias("v"))
    m = m.select((F.col("session_id") % 7).alias("track_id"), F.concat("channel", F.lit("_"), F.col("session_id").cast("string")).alias("name"), F.when(F.col("channel") != "error", F.col("v")).alias("dist"))
    return out(tracks.markers_by_distance(m).drop("dist"))


def _track(spark, sf):
    """The ellipse as a stored track of 180 segments, one for each fleet of seven sessions' laps."""
    t = fx.table(spark, sf, "events").select((F.col("user_id") % 7).alias("track_id")).distinct().withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(180))))
    a = 2 * math.pi * F.col("seq") / 180
    return t.select("track_id", "seq", (45 + 0.004 * F.sin(a)).alias("lat"), (9 + 0.006 * F.cos(a)).alias("lon"))


_M = "(pi() / 180 * 6371008.8)"
# Every point with every segment of its track.
_NEAREST = f"""
WITH t AS (SELECT i AS seq, 45 + 0.004 * sin(2 * pi() * i / 180) AS lat, 9 + 0.006 * cos(2 * pi() * i / 180) AS lon FROM (SELECT unnest(range(0, 181)) AS i)),
seg AS (SELECT seq, lat, lon, lead(lat) OVER (ORDER BY seq) AS lat1, lead(lon) OVER (ORDER BY seq) AS lon1 FROM t QUALIFY lat1 IS NOT NULL),
d AS (
  SELECT p.session_id, p.tc, seq,
         (s.lon - p.lon) * cos(radians(p.lat)) * {_M} AS ax, (s.lat - p.lat) * {_M} AS ay,
         (s.lon1 - s.lon) * cos(radians(p.lat)) * {_M} AS dx, (s.lat1 - s.lat) * {_M} AS dy
  FROM fx_fixes p, seg s),
e AS (SELECT *, greatest(0.0, least(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS u FROM d)
SELECT session_id, tc, session_id % 7 AS track_id,
       round(arg_min(seq + u, (ax + u * dx) * (ax + u * dx) + (ay + u * dy) * (ay + u * dy)), 3) AS idx,
       round(min(sqrt((ax + u * dx) * (ax + u * dx) + (ay + u * dy) * (ay + u * dy))), 3) AS off
FROM e GROUP BY session_id, tc"""


@query("j7_nearest_on_track", _NEAREST)
def j7(spark, sf):
    p = fx.fixes(spark, sf).withColumn("track_id", F.col("session_id") % 7)
    return out(tracks.nearest_on_track(p, _track(spark, sf)).select("session_id", "tc", "track_id", "idx", "off"), 3)


_FAR = "CASE session_id % 3 WHEN 0 THEN 0.0001 WHEN 1 THEN 0.045 ELSE 9.0 END"


@query("j7_far_points", _NEAREST.replace("FROM fx_fixes p", f"FROM (SELECT session_id, tc, lat + {_FAR} AS lat, lon FROM fx_fixes WHERE CAST(tc AS BIGINT) % 20000 = 0) p"))
def j7b(spark, sf):
    # A third of the sessions ten metres off the track's line, a third five kilometres, a third a thousand.
    k = F.col("session_id") % 3
    p = fx.fixes(spark, sf).filter("tc % 20000 = 0").withColumn("track_id", F.col("session_id") % 7)
    p = p.withColumn("lat", F.col("lat") + F.when(k == 0, 0.0001).when(k == 1, 0.045).otherwise(9.0))
    return out(tracks.nearest_on_track(p, _track(spark, sf)).select("session_id", "tc", "track_id", "idx", "off"), 3)


# Two circuits a few hundred metres apart and one far away; a third of the sessions run on each of the two, and a
# third on the first in the other direction.
_CIRCUITS = f"""
WITH t AS (
  SELECT track_id, i AS seq, 45 + 0.004 * sin(2 * pi() * i / 180) + CASE track_id WHEN 1 THEN 0.003 WHEN 2 THEN 1.0 ELSE 0 END AS lat, 9 + 0.006 * cos(2 * pi() * i / 180) AS lon
  FROM (SELECT unnest(range(0, 181)) AS i), (SELECT unnest([0, 1, 2]) AS track_id)),
seg AS (SELECT track_id, seq, lat, lon, lead(lat) OVER w AS lat1, lead(lon) OVER w AS lon1 FROM t WINDOW w AS (PARTITION BY track_id ORDER BY seq) QUALIFY lat1 IS NOT NULL),
path AS (SELECT session_id, CASE WHEN session_id % 3 = 2 THEN 60000 - tc ELSE tc END AS tc, lat + CASE WHEN session_id % 3 = 1 THEN 0.003 ELSE 0 END AS lat, lon FROM fx_fixes WHERE tc < 50000),
d AS (
  SELECT p.session_id, p.tc, s.track_id, seq, (s.lon - p.lon) * cos(radians(p.lat)) * {_M} AS ax, (s.lat - p.lat) * {_M} AS ay,
         (s.lon1 - s.lon) * cos(radians(p.lat)) * {_M} AS dx, (s.lat1 - s.lat) * {_M} AS dy
  FROM path p, seg s),
e AS (SELECT *, greatest(0.0, least(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS u FROM d),
near AS (SELECT session_id, tc, track_id, min(sqrt((ax + u * dx) * (ax + u * dx) + (ay + u * dy) * (ay + u * dy))) AS off, arg_min(seq + u, (ax + u * dx) * (ax + u * dx) + (ay + u * dy) * (ay + u * dy)) AS idx FROM e GROUP BY ALL),
steps AS (SELECT *, idx > lag(idx) OVER (PARTITION BY session_id, track_id ORDER BY tc) AS up FROM near),
fit AS (SELECT session_id, track_id, max(off) AS off, avg(up::INT) AS up FROM steps GROUP BY ALL)
SELECT session_id, arg_min(track_id, off) AS track_id, round(min(off), 3) AS off FROM fit WHERE off < 15 AND up > 0.9 GROUP BY session_id"""


@query("j8_match_circuits", _CIRCUITS)
def j8b(spark, sf):
    one = _track(spark, sf).filter("track_id = 0")
    shifted = lambda k, by: one.withColumn("track_id", F.lit(k).cast("long")).withColumn("lat", F.col("lat") + by)
    path = fx.fixes(spark, sf).filter("tc < 50000").select("session_id", F.when(F.col("session_id") % 3 == 2, 60_000 - F.col("tc")).otherwise(F.col("tc")).alias("tc"), (F.col("lat") + F.when(F.col("session_id") % 3 == 1, 0.003).otherwise(0.0)).alias("lat"), "lon")
    return out(tracks.match_track(path, one.unionByName(shifted(1, 0.003)).unionByName(shifted(2, 1.0))), 3)


@query("j8_match_track", "SELECT DISTINCT user_id AS session_id, 0 AS track_id FROM events")
def j8(spark, sf):
    own = _track(spark, sf).filter("track_id = 0")
    away = own.withColumn("track_id", F.lit(1).cast("long")).withColumn("lat", F.col("lat") + 0.002)
    path = fx.fixes(spark, sf).select("session_id", "tc", "lat", "lon")
    return tracks.match_track(path, own.withColumn("track_id", F.col("track_id").cast("long")).unionByName(away)).select("session_id", "track_id")


# Bearing over one point of 4 m, change over two, speed one point on, mean of four around that.
_TURNS = """
WITH p AS (SELECT session_id AS track_id, CAST(tc / 1000 AS BIGINT) AS seq, radians(lat) AS a, radians(lon) AS o FROM fx_fixes),
n AS (SELECT *, lead(a) OVER w AS a1, lead(o) OVER w AS o1 FROM p WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
b AS (SELECT track_id, seq, a, o, degrees(atan2(cos(a1) * sin(o1 - o), cos(a) * sin(a1) - sin(a) * cos(a1) * cos(o1 - o))) AS brg FROM n),
c AS (SELECT *, lead(brg, 2) OVER (PARTITION BY track_id ORDER BY seq) - brg AS turn FROM b),
r AS (SELECT *, ((turn + 540) - 360 * floor((turn + 540) / 360) - 180) * 30 AS raw FROM c),
m AS (SELECT *, avg(raw) OVER w AS rate, count(raw) OVER w AS n FROM r WINDOW w AS (PARTITION BY track_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING))
SELECT track_id, seq, round(degrees(a), 4) AS lat, round(degrees(o), 4) AS lon, CASE WHEN n = 4 THEN round(rate, 4) + 0.0 END AS rate FROM m"""


@query("w8_turn_rate", _TURNS)
def w8(spark, sf):
    p = fx.fixes(spark, sf).select(F.col("session_id").alias("track_id"), (F.col("tc") / 1000).cast("long").alias("seq"), "lat", "lon", F.lit(30.0).alias("speed"))
    return out(tracks.turn_rate(p, 4.0), 4)


_WAVES = "(SELECT session_id AS track_id, seq, sin(seq / 12.0::DOUBLE) * 260 + value / 100 AS rate FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tc) AS seq FROM fx_samples))"


@query("w9_segment_track", _segments_sql(_WAVES, 1.0))
def w9(spark, sf):
    s = fx.samples(spark, sf).withColumn("seq", F.row_number().over(Window.partitionBy("session_id").orderBy("tc")).cast("long"))
    wave = F.sin(F.col("seq") / 12.0) * 260 + F.col("value") / 100
    return tracks.segment_track(s.select(F.col("session_id").alias("track_id"), "seq", wave.alias("rate")))


_EVEN = """WITH cur AS (SELECT l.session_id, l.lap_num, i, start_dist + i * 20000.0 AS dist, round(start_dist + i * 20000.0, 6) AS at FROM fx_dlaps l, LATERAL (SELECT unnest(range(0, CAST(floor(round(end_dist - start_dist, 6) / 20000) AS BIGINT) + 1)) AS i)),
inv AS (SELECT p.*, a.k_hi AS k0, a.d_hi AS d0, b.k_lo AS k1, b.d_lo AS d1 FROM cur p ASOF LEFT JOIN fx_places a ON p.session_id = a.session_id AND p.at >= a.at ASOF LEFT JOIN fx_places b ON p.session_id = b.session_id AND p.at < b.at),
t AS (SELECT session_id, lap_num, i, CASE WHEN k0 IS NULL THEN 0.0 WHEN k1 IS NULL THEN k0 * 1000.0 ELSE (k0 + greatest(0, least(1, (dist - d0) / (d1 - d0)))) * 1000 END AS tc FROM inv),
v AS (SELECT * FROM fx_samples WHERE channel = 'view'),
p0 AS (SELECT t.*, s.tc AS t0, s.value AS v0 FROM t ASOF LEFT JOIN v s ON t.session_id = s.session_id AND t.tc >= s.tc),
p1 AS (SELECT p0.*, s.tc AS t1, s.value AS v1 FROM p0 ASOF LEFT JOIN v s ON p0.session_id = s.session_id AND p0.tc <= s.tc)
SELECT session_id, lap_num, 'view' AS channel, i, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (tc - t0) / (t1 - t0) END, 3) AS value FROM p1"""


@query("w7_resample_by_distance", _EVEN)
def w7(spark, sf):
    view = fx.samples(spark, sf).filter("channel = 'view'")
    lp, m = fx.mapped_laps(spark, sf)
    return out(distance.resample_by_distance(view, lp, m, 20000.0, fx.GRID_MS), 3)


# Sectors, pairs, cursors -------------------------------------------------------------------------


def _sectors(spark, sf):
    lp, m = fx.mapped_laps(spark, sf)
    length = laps.lap_distances(lp).groupBy("session_id").agg(F.first("median_dist").alias("length"))
    marks = lp.select("session_id").distinct().join(length, "session_id").withColumn("seq", F.explode(F.sequence(F.lit(1), F.lit(4)))).select("session_id", "seq", F.concat(F.lit("S"), F.col("seq").cast("string")).alias("name"), (F.col("length") * F.col("seq") / 5).alias("dist"))
    return reports.sector_times(lp, marks, m, length, fx.GRID_MS)


_DL = "(SELECT *, end_dist - start_dist AS dist, row_number() OVER (PARTITION BY session_id ORDER BY lap_num) AS i, count(*) OVER (PARTITION BY session_id) AS n FROM fx_dlaps)"
_SECT = f"""WITH len AS (SELECT session_id, median(dist) AS length FROM {_DL} WHERE i > 1 AND i < n GROUP BY session_id),
allm AS (SELECT l.session_id, l.lap_num, l.start_tc, l.start_dist, l.end_dist, length, s AS seq, l.start_dist + length * s / 5 AS dist FROM fx_dlaps l JOIN len USING (session_id), (SELECT unnest(range(1, 5)) AS s)),
ok AS (SELECT * FROM allm WHERE end_dist - start_dist >= 0.5 * length AND dist <= end_dist),
inv AS (SELECT p.*, a.k AS k0, a.dist AS d0, b.k AS k1, b.dist AS d1 FROM ok p ASOF LEFT JOIN fx_dist a ON p.session_id = a.session_id AND p.dist >= a.dist ASOF LEFT JOIN fx_dist b ON p.session_id = b.session_id AND p.dist < b.dist),
t AS (SELECT *, CASE WHEN k0 IS NULL THEN 0.0 WHEN k1 IS NULL THEN k0 * 1000.0 ELSE (k0 + (dist - d0) / (d1 - d0)) * 1000 END AS tc FROM inv),
b AS (SELECT *, coalesce(max(tc) OVER (PARTITION BY session_id, lap_num ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start_tc) AS before FROM t),
f AS (SELECT m.session_id, m.lap_num, m.seq, CASE WHEN b.tc > b.before THEN b.tc - b.before END AS sector FROM allm m LEFT JOIN b ON m.session_id = b.session_id AND m.lap_num = b.lap_num AND m.seq = b.seq)"""


@query("a7_sector_times", f"{_SECT} SELECT session_id, lap_num, seq, round(sector, 0) + 0.0 AS sector, round(min(sector) OVER (PARTITION BY session_id, seq), 0) + 0.0 AS best FROM f")
def a7(spark, sf):
    return out(_sectors(spark, sf).select("session_id", "lap_num", "seq", "sector", "best"), 0)


_BAND = "CASE WHEN delta <= 1 THEN 'best' WHEN delta < 100 THEN '<0.1' WHEN delta < 300 THEN '<0.3' WHEN delta < 500 THEN '<0.5' WHEN delta >= 500 THEN 'slower' END"


@query("a7_delta_and_band", f"{_SECT}, g AS (SELECT session_id, lap_num, seq, sector - min(sector) OVER (PARTITION BY session_id, seq) AS delta FROM f) SELECT session_id, lap_num, seq, round(delta, 0) + 0.0 AS delta, {_BAND} AS band FROM g")
def a7c(spark, sf):
    return out(_sectors(spark, sf).select("session_id", "lap_num", "seq", "delta", "band"), 0)


@query("a7_best_total", f"{_SECT}, g AS (SELECT session_id, seq, min(sector) AS b FROM f GROUP BY ALL) SELECT session_id, round(sum(b), 0) + 0.0 AS best_total FROM g GROUP BY session_id")
def a7b(spark, sf):
    return out(reports.best_total(_sectors(spark, sf)), 0)


_PAIRS = """WITH x AS (SELECT s.session_id, l.lap_num, s.tc, s.value AS x FROM fx_samples s JOIN fx_laps l ON s.session_id = l.session_id AND s.tc >= l.start_tc AND s.tc <= l.end_tc AND l.end_tc > l.start_tc WHERE channel = 'click'),
v AS (SELECT * FROM fx_samples WHERE channel = 'view'),
p AS (SELECT x.*, v.tc AS t0, v.value AS v0 FROM x ASOF LEFT JOIN v ON x.session_id = v.session_id AND x.tc >= v.tc),
n AS (SELECT p.*, v.tc AS t1, v.value AS v1 FROM p ASOF LEFT JOIN v ON p.session_id = v.session_id AND p.tc <= v.tc)
SELECT session_id, lap_num, round(tc, 6) AS tc, round(x, 6) AS x, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (tc - t0) / (t1 - t0) END, 6) AS y FROM n WHERE t0 IS NOT NULL OR t1 IS NOT NULL"""


@query("a9_scatter_pairs", _PAIRS)
def a9(spark, sf):
    return out(reports.scatter_pairs(fx.samples(spark, sf), fx.laps(spark, sf), "click", "view"))


@query("w12_values_at_cursor", "WITH cur AS (SELECT session_id, lap_num, start_tc + 20000 AS tc, c.channel FROM fx_laps, (VALUES ('click'), ('view')) c(channel) WHERE start_tc + 20000 < end_tc), p AS (SELECT a.*, s.tc AS t0, s.value AS v0 FROM cur a ASOF LEFT JOIN fx_samples s ON a.session_id = s.session_id AND a.channel = s.channel AND a.tc >= s.tc), n AS (SELECT p.*, s.tc AS t1, s.value AS v1 FROM p ASOF LEFT JOIN fx_samples s ON p.session_id = s.session_id AND p.channel = s.channel AND p.tc <= s.tc), v AS (SELECT session_id, lap_num, channel, CASE WHEN channel = 'view' THEN coalesce(v0, v1) WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (tc - t0) / (t1 - t0) END AS value FROM n) SELECT session_id, lap_num, channel, round(value, 6) AS value, round(value - first_value(value) OVER (PARTITION BY session_id, channel ORDER BY lap_num), 6) + 0.0 AS delta FROM v")
def w12(spark, sf):
    return out(reports.values_at_cursor(fx.samples(spark, sf), fx.laps(spark, sf), {"click": True, "view": False}, 20000.0))


# Sources and catalog -----------------------------------------------------------------------------


#: Lines as they are, in files whose names end in .log.
def _wide_logs(spark, sf):
    """One comma-separated log for each session, written from the samples by Spark's tasks."""
    names = ["click", "view", "purchase", "signup", "error"]
    s = fx.samples(spark, sf)
    wide = s.groupBy("session_id", "tc").pivot("channel", names).agg(F.max("value"))
    rows = wide.select("session_id", F.col("tc").alias("o"), F.concat_ws(",", F.format_string("%.6f", "tc"), *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]).alias("value"))
    head = s.select("session_id").distinct().select("session_id", F.lit(-1.0).alias("o"), F.lit(",".join(['"Interval"|"ms"', *[f'"{n}"|"u"' for n in names]])).alias("value"))
    path = scratch(spark, "wide")
    storage.write_logs(rows.unionByName(head), path)
    return path


def _session(df):
    return df.withColumn("session_id", F.regexp_extract("path", r"session_id=(\d+)", 1).cast("long")).drop("path")


@query("s1_read_wide_log", "SELECT session_id, channel, 'u' AS units, round(tc - min(tc) OVER (PARTITION BY session_id), 6) + 0.0 AS tc, round(value, 6) AS value FROM fx_samples WHERE channel IN ('click', 'view', 'purchase', 'signup', 'error')")
def s1(spark, sf):
    return out(_session(text_logs.read_wide_log(spark, _wide_logs(spark, sf), "*.log")))


@query("s2_read_sectioned_log", "WITH r AS (SELECT session_id, i, tc / 1000 AS s, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tc) AS i FROM fx_fixes)) SELECT session_id, channel, CASE channel WHEN 'oil' THEN 'bar' ELSE 'deg' END AS units, round(s * 1000, 3) AS tc, round(CASE channel WHEN 'latitude' THEN round(lat * 60, 6) / 60 WHEN 'longitude' THEN round(-lon * 60, 6) / -60 ELSE s END, 5) + 0.0 AS value FROM r, (VALUES ('latitude'), ('longitude'), ('oil')) c(channel)")
def s2(spark, sf):
    # Sessions run over midnight: ten minutes from 23:55.
    f = fx.fixes(spark, sf).withColumn("s", F.col("tc") / 1000 + 86100)
    d = F.pmod(F.col("s"), F.lit(86400.0))
    hms = F.format_string("%02d%02d%06.3f", F.floor(d / 3600).cast("int"), F.floor(F.pmod(d, F.lit(3600.0)) / 60).cast("int"), F.pmod(d, F.lit(60.0)))
    rows = f.select("session_id", F.col("tc").alias("o"), F.concat_ws(" ", hms, F.format_string("%.6f", F.col("lat") * 60), F.format_string("%.6f", -F.col("lon") * 60), F.format_string("%.3f", F.col("tc") / 1000)).alias("value"))
    text = "[header]\ntime\nlatitude\nlongitude\noil\n\n[channel units]\ns\nbar\n\n[laptiming]\nStart -540.36 2700.0 -540.36 2700.0\n\n[data]"
    head = f.select("session_id").distinct().select("session_id", F.lit(-1.0).alias("o"), F.lit(text).alias("value"))
    path = scratch(spark, "sectioned")
    storage.write_logs(rows.unionByName(head), path, "vbo")
    return out(_session(text_logs.read_sectioned_log(spark, path)).withColumn("tc", F.round("tc", 3)), 5)


@query("s7_write_read_samples", "SELECT session_id, channel, tc, round(value, 6) AS value FROM fx_samples WHERE channel IN ('click', 'view')")
def s7(spark, sf):
    path = scratch(spark, "samples")
    storage.write_samples(fx.samples(spark, sf), path, buckets=16)
    return out(storage.read_samples(spark, path, channels=["click", "view"]))


@query("n12_infer_decimals", "SELECT 'click' AS channel, CAST(length(regexp_extract(arg_min(CAST(value AS VARCHAR), event_id), '\\.(.*)$', 1)) AS BIGINT) AS dec_pts FROM (SELECT value, event_id, row_number() OVER (ORDER BY event_id) AS line FROM ev WHERE channel = 'click') WHERE line <= 1000")
def n12(spark, sf):
    # The first lines of one channel over all sessions, as one log.
    e = fx.events(spark, sf).filter("channel = 'click'").select("channel", F.col("event_id").alias("line0"), F.col("value").cast("string").alias("cell"))
    first = e.groupBy("channel").agg(F.min("line0").alias("a"))
    return out(normalize.infer_decimals(e.join(F.broadcast(first), "channel").select("channel", (F.col("line0") - F.col("a")).alias("line"), "cell")))


def _sessions(spark, sf):
    """Sessions with metadata from their events: driver by number, vehicle by first channel, start by first time."""
    e = fx.events(spark, sf)
    first = e.groupBy("session_id").agg(F.min_by("channel", "tc").alias("vehicle"), F.min("ts").alias("at"))
    values = {"Driver": F.concat(F.lit("driver_"), (F.col("session_id") % 5).cast("string")), "Vehicle": F.col("vehicle"), "Log Date": F.date_format("at", "MM/dd/yyyy"), "Log Time": F.date_format("at", "HH:mm:ss")}
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])
    entries = first.select("session_id", F.lit("wide text").alias("format"), F.explode(pairs).alias("p")).select("session_id", "format", "p.key", "p.value")
    return catalog.session_metadata(entries)


_META = "(SELECT session_id, 'driver_' || (session_id % 5) AS driver, arg_min(channel, tc) AS vehicle, date_trunc('second', min(ts)) AS began FROM ev GROUP BY session_id)"


@query("s6_session_metadata", f"SELECT session_id, driver, vehicle, epoch(began) AS started, true AS readable FROM {_META}")
def s6(spark, sf):
    s = _sessions(spark, sf)
    return out(s.select("session_id", F.col("metadata")["Driver"].alias("driver"), F.col("metadata")["Vehicle"].alias("vehicle"), F.unix_timestamp("started_at").cast("double").alias("started"), "readable"))


@query("s6_venue", f"SELECT session_id, CASE session_id % 3 WHEN 0 THEN 'Track 0' WHEN 1 THEN 'Track 1' END AS venue, driver FROM {_META}")
def s6b(spark, sf):
    # Two sessions of three run on a stored track; the third keeps its metadata as it was.
    s = _sessions(spark, sf)
    found = s.select("session_id", (F.col("session_id") % 3).alias("track_id")).filter("track_id < 2")
    names = found.select("track_id").distinct().select("track_id", F.concat(F.lit("Track "), F.col("track_id").cast("string")).alias("name"))
    v = catalog.with_venue(s, found, names)
    return v.select("session_id", F.col("metadata")["Venue"].alias("venue"), F.col("metadata")["Driver"].alias("driver"))


@query("p3_search_channels", "SELECT DISTINCT channel || '_' || (session_id % 7) AS channel FROM fx_samples WHERE (channel || '_' || (session_id % 7)) ~ '^p.*' AND session_id % 7 IN (3)")
def p3(spark, sf):
    c = fx.samples(spark, sf).select(F.concat("channel", F.lit("_"), (F.col("session_id") % 7).cast("string")).alias("channel")).distinct()
    return catalog.search_channels(c, "P*r 3")


@query("p4_search_catalog", f"SELECT session_id FROM {_META} WHERE driver IN ('driver_1', 'driver_3') AND vehicle LIKE 'c%'")
def p4(spark, sf):
    return catalog.search_catalog(_sessions(spark, sf), "cl", {"Driver": ["driver_1", "driver_3"]}).select("session_id")


@query("a12_facets", f"SELECT 'Driver' AS facet, driver AS value, count(*) AS n FROM {_META} GROUP BY driver UNION ALL SELECT 'Vehicle', vehicle, count(*) FROM {_META} GROUP BY vehicle")
def a12(spark, sf):
    return catalog.facets(_sessions(spark, sf))


@query("o1_session_order", f"SELECT session_id, row_number() OVER (ORDER BY began, session_id) AS place FROM {_META}")
def o1(spark, sf):
    return catalog.session_order(_sessions(spark, sf)).select("session_id", "place")


@query("s4_catalog_changes", "SELECT change, count(*) AS n FROM (SELECT CASE WHEN user_id % 5 = 0 THEN 'new' WHEN user_id % 5 = 1 THEN 'deleted' WHEN user_id % 5 = 2 THEN 'changed' ELSE 'unchanged' END AS change FROM (SELECT DISTINCT user_id FROM events)) GROUP BY change")
def s4(spark, sf):
    u = fx.events(spark, sf).groupBy("session_id").agg(F.count(F.lit(1)).alias("size"), F.max("ts").alias("mtime")).withColumn("path", F.concat(F.lit("/logs/"), F.col("session_id").cast("string"), F.lit(".log")))
    k = F.col("session_id") % 5
    old = u.filter(k != 0).withColumn("size", F.when(k == 2, F.col("size") + 1).otherwise(F.col("size")))
    return catalog.catalog_changes(u.filter(k != 1), old).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("s4_changed_paths", "SELECT user_id AS session_id, CASE user_id % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'deleted' WHEN 2 THEN 'changed' WHEN 3 THEN 'changed' ELSE 'unchanged' END AS change FROM events GROUP BY user_id")
def s4b(spark, sf):
    # Of five files one is new, one gone, one of another size, one of another time, one as it was.
    u = fx.events(spark, sf).groupBy("session_id").agg(F.count(F.lit(1)).alias("size"), F.max("ts").alias("mtime")).withColumn("path", F.concat(F.lit("/logs/session_id="), F.col("session_id").cast("string"), F.lit("/a.log")))
    k = F.col("session_id") % 5
    old = u.filter(k != 0).withColumn("size", F.when(k == 2, F.col("size") + 1).otherwise(F.col("size"))).withColumn("mtime", F.when(k == 3, F.col("mtime") - F.expr("INTERVAL 1 SECOND")).otherwise(F.col("mtime")))
    return _session(catalog.catalog_changes(u.filter(k != 1), old))


@query("u4_removed", "SELECT DISTINCT user_id AS session_id FROM events WHERE user_id % 5 = 1")
def u4(spark, sf):
    u = fx.events(spark, sf).select("session_id").distinct().withColumn("path", F.col("session_id").cast("string"))
    return catalog.removed(u.filter("session_id % 5 <> 1"), u).select("session_id")


@query("s3_scan_catalog", "SELECT 'wide text' AS format, count(DISTINCT user_id) AS n FROM events")
def s3(spark, sf):
    return catalog.scan_catalog(spark, _wide_logs(spark, sf)).groupBy("format").agg(F.count(F.lit(1)).alias("n"))


@query("s3_scan_paths", "SELECT user_id AS session_id, 'wide text' AS format, true AS filled FROM events GROUP BY user_id")
def s3b(spark, sf):
    return _session(catalog.scan_catalog(spark, _wide_logs(spark, sf)).select("path", "format", (F.col("size") > 0).alias("filled")))


@query("s5_detect_format", "SELECT CASE user_id % 4 WHEN 0 THEN 'wide text' WHEN 1 THEN 'sectioned text' WHEN 2 THEN 'xrk' END AS format, count(*) AS n FROM events GROUP BY 1")
def s5(spark, sf):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".LOG", ".vbo", ".Xrk", ".pdf")]), (F.col("user_id") % 4 + 1).cast("int"))
    e = fx.table(spark, sf, "events").select(catalog.detect_format(F.concat(F.lit("/a.b/run"), F.col("user_id").cast("string"), ext)).alias("format"))
    return e.groupBy("format").agg(F.count(F.lit(1)).alias("n"))


@query("j9_align_clock", f"SELECT session_id, round((((epoch(began) - 18 - (epoch(began) - 7200 - session_id)) + 1800) % 3600 - 1800) * 1000, 3) AS offset_ms FROM {_META}")
def j9(spark, sf):
    s = _sessions(spark, sf).select("session_id", F.unix_timestamp("started_at").cast("double").alias("log_s"))
    return out(catalog.align_clock(s, s.select("session_id", (F.col("log_s") - 7200 - F.col("session_id")).alias("recording_s"))), 3)


@query("p6_effective_properties", "SELECT channel, CASE channel WHEN 'click' THEN 'derived' WHEN 'view' THEN 'over' ELSE 'u' || min(session_id) END AS units, CASE channel WHEN 'click' THEN 3 WHEN 'view' THEN 1 ELSE 2 END AS dec_pts FROM fx_samples GROUP BY channel")
def p6(spark, sf):
    c = fx.samples(spark, sf).groupBy("session_id", "channel").agg(F.lit(2).alias("dec_pts")).select(F.col("session_id").alias("load_order"), "channel", F.concat(F.lit("u"), F.col("session_id").cast("string")).alias("units"), "dec_pts", F.lit(True).alias("interpolate"))
    kind = "channel string, units string, dec_pts int, interpolate boolean"
    over = spark.createDataFrame([("view", "over", 1, None), ("click", "lost", 9, False)], kind)
    made = spark.createDataFrame([("click", "derived", 3, None)], kind)
    return out(catalog.effective_properties(c, over, made).select("channel", "units", "dec_pts"))


@query("p7_key_channels", "SELECT session_id, CASE WHEN bool_or(channel = 'click') THEN 'click' END AS key_speed, CASE WHEN bool_or(channel = 'view') THEN 'view' END AS key_lat, CAST(NULL AS VARCHAR) AS key_lon FROM fx_samples GROUP BY session_id")
def p7(spark, sf):
    c = fx.samples(spark, sf).select("session_id", "channel").distinct()
    s = c.select("session_id").distinct().select("session_id", F.lit("click").alias("key_speed"), F.lit("view").alias("key_lat"), F.lit("absent").alias("key_lon"), F.lit(None).cast("string").alias("key_alt"))
    return catalog.key_channels(s, c).select("session_id", "key_speed", "key_lat", "key_lon")


# Laps from other sources -------------------------------------------------------------------------


@query("w3_laps_from_odometer", "SELECT session_id, lap_num - min(lap_num) OVER (PARTITION BY session_id) AS lap_num, round(start_tc, 3) AS start_tc, round(end_tc, 3) AS end_tc FROM fx_laps WHERE end_tc >= start_tc")
def w3(spark, sf):
    # The counter one up (no lap 0), at a distance of nothing: boundaries stay where the counter changes.
    c = fx.counter(spark, sf).select("session_id", "tc", (F.col("value") + 1).alias("lap"), F.lit(0.0).alias("lap_dist"), F.lit(10.0).alias("speed"))
    return out(laps.laps_from_odometer(c), 3)


_ODOMETER = """WITH w AS (
  SELECT session_id, tc, coalesce(value, 0) AS value,
         CASE WHEN session_id % 5 = 0 AND tc > 2000000 THEN 0 ELSE 1 + sum(CASE WHEN channel = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY tc, event_id) END AS lap
  FROM ev),
l AS (SELECT *, lag(lap) OVER p AS lap0, lag(tc) OVER p AS tc0 FROM w WINDOW p AS (PARTITION BY session_id ORDER BY tc)),
b AS (SELECT session_id, tc, lap, CASE WHEN lap = 0 THEN tc ELSE greatest(tc0, tc - value * 100 / 40 * 1000) END AS mark FROM l WHERE lap0 <> lap),
cuts AS (
  SELECT DISTINCT session_id, -1.0 AS o, 0.0 AS mark FROM w
  UNION ALL SELECT session_id, tc, mark FROM b
  UNION ALL SELECT session_id, 1e12, max(tc) FROM w WHERE session_id NOT IN (SELECT session_id FROM b WHERE lap = 0) GROUP BY session_id)
SELECT session_id, row_number() OVER p - 1 AS lap_num, round(mark, 3) + 0.0 AS start_tc, round(lead(mark) OVER p, 3) + 0.0 AS end_tc
FROM cuts WINDOW p AS (PARTITION BY session_id ORDER BY o) QUALIFY lead(mark) OVER p IS NOT NULL"""


@query("w3_laps_put_back", _ODOMETER)
def w3b(spark, sf):
    # Lap distances that put boundaries back, at times beyond the sample ahead; some sessions end with lap 0.
    e, w = fx.events(spark, sf), Window.partitionBy("session_id").orderBy("tc", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    lap = F.sum((F.col("channel") == "signup").cast("double")).over(w) + 1
    c = e.select("session_id", "tc", lap.alias("lap"), (F.coalesce("value", F.lit(0.0)) * 100).alias("lap_dist"), F.lit(40.0).alias("speed"))
    c = c.withColumn("lap", F.when((F.col("session_id") % 5 == 0) & (F.col("tc") > 2_000_000), 0.0).otherwise(F.col("lap")))
    return out(laps.laps_from_odometer(c), 3)


@query("w4_laps_from_beacon", "WITH b AS (SELECT session_id, 1 AS part, tc - 1000 + 50 AS m FROM ev WHERE channel = 'signup'), c AS (SELECT session_id, part, m FROM b UNION ALL SELECT session_id, 0, 0 FROM fx_ends UNION ALL SELECT session_id, 2, max(tc) + 0.002 FROM ev GROUP BY session_id) SELECT session_id, row_number() OVER w - 1 AS lap_num, floor(m) AS start_tc, floor(lead(m) OVER w) AS end_tc FROM c WINDOW w AS (PARTITION BY session_id ORDER BY part, m) QUALIFY lead(m) OVER w IS NOT NULL")
def w4(spark, sf):
    # Each sign-up sends -1, an offset of 50, then 100, a thousandth apart.
    e = fx.events(spark, sf)
    codes = F.explode(F.array(*[F.struct(F.lit(i * 0.001).alias("dt"), F.lit(float(v)).alias("value")) for i, v in enumerate((-1, 16384 + 50, 100))]))
    b = e.filter("channel = 'signup'").select("session_id", F.lit("Beacon").alias("channel"), "tc", codes.alias("c")).select("session_id", "channel", (F.col("tc") + F.col("c.dt")).alias("tc"), "c.value")
    last = e.groupBy("session_id").agg((F.max("tc") + 0.002).alias("tc")).select("session_id", F.lit("x").alias("channel"), "tc", F.lit(0.0).alias("value"))
    return out(laps.laps_from_beacon(b.unionByName(last)))


@query("w5_laps_from_messages", "SELECT session_id, lap_num, round(start_tc, 6) AS start_tc, round(end_tc, 6) AS end_tc FROM fx_laps")
def w5(spark, sf):
    # One message a lap, a third of the inner ones lost, others repeated: the lost are inferred.
    x = fx.laps(spark, sf)
    w = Window.partitionBy("session_id").orderBy("lap_num")
    x = x.withColumn("i", F.row_number().over(w)).withColumn("more", F.lead("lap_num").over(w).isNotNull())
    x = x.filter(~((F.col("i") % 3 == 0) & F.col("more")))
    m = x.select("session_id", (F.col("i") * 10).alias("seq"), F.lit(0).alias("segment"), F.col("lap_num").alias("lap"), (F.col("end_tc") - F.col("start_tc")).alias("duration"), "end_tc")
    again = m.withColumn("seq", F.col("seq") + 1)
    part = m.withColumn("seq", F.col("seq") + 2).withColumn("segment", F.lit(1))
    return out(laps.laps_from_messages(m.unionByName(again).unionByName(part)))


# Derived channels --------------------------------------------------------------------------------

_ALIGNED = "(SELECT session_id, tc, coalesce(last_value(CASE WHEN channel = 'click' THEN value END IGNORE NULLS) OVER w, first_value(CASE WHEN channel = 'click' THEN value END IGNORE NULLS) OVER n) AS a, coalesce(last_value(CASE WHEN channel = 'view' THEN value END IGNORE NULLS) OVER w, first_value(CASE WHEN channel = 'view' THEN value END IGNORE NULLS) OVER n) AS b FROM fx_samples WHERE channel IN ('click', 'view') WINDOW w AS (PARTITION BY session_id ORDER BY tc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY session_id ORDER BY tc ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


# A ratio over 0, or of a channel that a session lacks, is no sample. Halves are rounded up by their decimal digits, as Spark does.
_RATIO = f"(SELECT session_id, tc, a / nullif(b, 0) AS ratio FROM {_ALIGNED} WHERE a IS NOT NULL AND b IS NOT NULL AND b <> 0)"


@query("x1_derive_channels", f"SELECT session_id, 'ratio' AS channel, tc, CAST(round(CAST(CAST(ratio AS VARCHAR) AS DECIMAL(38, 18)), 6) AS DOUBLE) AS value FROM {_RATIO} UNION ALL SELECT session_id, 'twice', tc, CAST(round(CAST(CAST(2 * ratio AS VARCHAR) AS DECIMAL(38, 18)), 6) AS DOUBLE) FROM {_RATIO}")
def x1(spark, sf):
    made = [
        derive.Derived("twice", "2 * r", {"r": "ratio"}, hold={"ratio"}),
        derive.Derived("ratio", "try_divide(a, b)", {"a": "click", "b": "view"}, hold={"click", "view"}),
        derive.Derived("loop", "x + 1", {"x": "loop"}),
    ]
    return out(derive.derive_channels(fx.samples(spark, sf), made))


@query(
    "f2_expressions",
    f"""WITH v AS (SELECT session_id, tc, a, b, a * 3.6 AS k FROM {_ALIGNED})
SELECT session_id, round(tc, 4) AS tc, name AS channel, round(CASE name
  WHEN 'power' THEN (a / 100) * (a / 100) * (a / 100) - b * b
  WHEN 'above' THEN CASE WHEN a > b THEN 1 ELSE 0 END + CASE WHEN a <= 50 THEN 2 ELSE 0 END + CASE WHEN a <> b THEN 4 ELSE 0 END
  WHEN 'logic' THEN CASE WHEN (a > 40 AND b > 40) OR NOT (a + b < 90) THEN 1 ELSE 0 END
  WHEN 'chosen' THEN CASE WHEN a > b THEN greatest(a, 30) ELSE least(b, 70) END + CASE WHEN a > 0 THEN ln(a) ELSE 0 END
  WHEN 'in kph' THEN k - a END, 4) + 0.0 AS value
FROM v, (SELECT unnest(['power', 'above', 'logic', 'chosen', 'in kph']) AS name)""",
)
def f2(spark, sf):
    # Power, comparisons, logic, choice, extremes, logarithm, and a reference in another unit.
    s = fx.samples(spark, sf).withColumn("units", F.when(F.col("channel") == "click", "m/s").otherwise(""))
    deps, hold = {"a": "click", "b": "view"}, {"click", "view"}
    made = [
        derive.Derived("power", "power(a / 100, 3) - power(b, 2)", deps, hold=hold),
        derive.Derived("above", "int(a > b) + 2 * int(a <= 50) + 4 * int(a != b)", deps, hold=hold),
        derive.Derived("logic", "int((a > 40 AND b > 40) OR NOT (a + b < 90))", deps, hold=hold),
        derive.Derived("chosen", "if(a > b, greatest(a, 30), least(b, 70)) + if(a > 0, ln(a), 0)", deps, hold=hold),
        derive.Derived("in kph", "k - a + 0 * b", {**deps, "k": "click"}, units={"k": "km/h"}, hold=hold),
    ]
    return out(derive.derive_channels(s, made), 4)


@query("x2_running_sum_in_chunks", f"SELECT session_id, 'run' AS channel, round(tc, 3) AS tc, round(sum(a - b) OVER (PARTITION BY session_id ORDER BY tc), 3) + 0.0 AS value FROM {_ALIGNED}")
def x2b(spark, sf):
    def gap(pdf, state):
        total = (pdf["click"] - pdf["view"]).cumsum() + (state or 0.0)
        return total, float(total.iloc[-1])

    derive.register_channel_fn("gap in chunks", gap)
    return out(derive.apply_channel_fn_in_chunks(fx.samples(spark, sf), "gap in chunks", {"click": False, "view": False}, "run", 1000), 3)


@query("x2_channel_function", f"SELECT session_id, 'run' AS channel, round(tc, 3) AS tc, round(sum(a - b) OVER (PARTITION BY session_id ORDER BY tc), 3) + 0.0 AS value FROM {_ALIGNED}")
def x2(spark, sf):
    derive.register_channel_fn("running gap", lambda pdf: (pdf["click"] - pdf["view"]).cumsum())
    return out(derive.apply_channel_fn(fx.samples(spark, sf), "running gap", {"click": False, "view": False}, "run"), 3)


# Streams -----------------------------------------------------------------------------------------


def _event_stream(spark, sf):
    kind = fx.table(spark, sf, "events").schema
    return spark.readStream.schema(kind).parquet(f"{sf}/events.parque[t]")


@query("t2_stream_channel_stats", "SELECT user_id AS session_id, event_type AS channel, epoch(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2024-01-01 00:00:00')) AS day, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value, round(avg(value), 6) AS mean_value, count(value) AS n FROM events GROUP BY ALL")
def t2(spark, sf):
    s = _event_stream(spark, sf).select(F.col("user_id").alias("session_id"), F.col("event_type").alias("channel"), "ts", "value")
    stats, path = jobs.stream_channel_stats(s, "1 day"), scratch(spark, "stats")
    run = stats.writeStream.outputMode("complete").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", scratch(spark, "stats-state")).trigger(availableNow=True).start()
    run.awaitTermination()
    return out(spark.read.schema(stats.schema).parquet(path).withColumn("day", F.unix_timestamp("window_start").cast("double")).drop("window_start"))


#: Rows in a file of a batch, about.
FED_A_FILE = 200_000


def _fed(df, spark, name, part):
    """A stream of a table in three batches: rows by ``part`` (0, 1 or 2), each in the same number of files."""
    feed, kind = scratch(spark, name), df.schema
    rows = fx.kept(df.withColumn("_part", part), f"{name}-rows")
    counts = {r._part: r.n for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Rows are dealt in turn from each of the table's few splits, far fewer than a file has rows: no file stays empty.
    files = 1 + min(counts.get(i, 0) for i in range(3)) // FED_A_FILE
    for i in range(3):
        own = rows.filter(F.col("_part") == i).drop("_part")
        (own.repartition(files) if files > 1 else own.coalesce(1)).write.mode("append").parquet(feed)
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(feed)


# Ten days to a batch. One row in 20 of the first five days comes with the last ten days, too late for its windows;
# one in 20 of each other's last day comes a batch late, in time.
_BATCH = "CASE WHEN day < 5 AND event_id % 20 = 3 THEN 2 WHEN day IN (9, 19) AND event_id % 20 = 5 THEN day // 10 + 1 ELSE least(day // 10, 2) END"


@query(
    "t2_stream_sliding_stats",
    f"""WITH days AS (SELECT *, CAST(floor(tc / 86400) AS BIGINT) AS day FROM ev),
batches AS (SELECT *, {_BATCH} AS batch FROM days),
kept AS (SELECT *, CAST(floor(tc / 43200) AS BIGINT) - w AS slot FROM batches, (SELECT unnest([0, 1]) AS w) WHERE NOT (day < 5 AND batch = 2))
SELECT session_id, channel, 1704067200 + slot * 43200.0 AS start, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value, round(avg(value), 6) AS mean_value, count(value) AS n
FROM kept GROUP BY session_id, channel, slot
HAVING slot * 43200 + 86400 <= (SELECT floor(max(tc) * 1000) / 1000 - 172800 FROM ev)""",
)
def t2b(spark, sf):
    # Windows of a day every half a day, in append mode: each comes out once, when the watermark has passed it.
    e = fx.events(spark, sf)
    day = F.floor(F.col("tc") / 86400)
    late = (day < 5) & (F.col("event_id") % 20 == 3)
    after = day.isin(9, 19) & (F.col("event_id") % 20 == 5)
    part = F.when(late, 2).when(after, F.floor(day / 10) + 1).otherwise(F.least(F.floor(day / 10), F.lit(2)))
    s = _fed(e.select("session_id", "channel", "ts", "value", part.alias("part")), spark, "late-feed", F.col("part"))
    stats, path = jobs.stream_channel_stats(s, "1 day", "12 hours", "2 days"), scratch(spark, "sliding")
    run = stats.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", scratch(spark, "sliding-state")).trigger(availableNow=True).start()
    run.awaitTermination()
    return out(spark.read.schema(stats.schema).parquet(path).withColumn("start", F.unix_timestamp("window_start").cast("double")).drop("window_start"))


_CLOSED = """WITH c AS (SELECT session_id, tc, value FROM fx_counter),
ends AS (SELECT session_id, max(tc) AS last FROM c GROUP BY session_id),
top AS (SELECT floor(max(tc) * 1000) / 1000 AS now FROM c)
SELECT l.session_id, l.lap_num, round(l.start_tc, 6) AS start_tc, round(l.end_tc, 6) AS end_tc
FROM (SELECT *, max(start_tc) OVER (PARTITION BY session_id) AS open FROM fx_laps) l JOIN ends USING (session_id), top
WHERE CASE WHEN l.start_tc < l.open THEN floor(l.end_tc * 1000) / 1000 <= now - 21600 ELSE floor(last * 1000) / 1000 + 43200 <= now - 21600 END"""


@query("t3_stream_laps", _CLOSED)
def t3(spark, sf):
    # Samples in three batches: one in seven of the last hours of a batch comes with the next. Half a day without samples ends a session.
    e, run = fx.events(spark, sf), Window.partitionBy("session_id").orderBy("tc", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    c = e.select("session_id", "ts", "tc", F.sum((F.col("channel") == "signup").cast("double")).over(run).alias("value"), "event_id")
    third = F.least(F.floor(F.col("tc") / 864_000), F.lit(2))
    late = (F.col("event_id") % 7 == 0) & (F.pmod(F.col("tc"), F.lit(864_000.0)) > 864_000 - 14_400)
    c = c.withColumn("part", F.least(third + late.cast("int"), F.lit(2))).drop("event_id")
    s, path = jobs.stream_laps(_fed(c, spark, "laps-feed", F.col("part")), "6 hours", 43_200_000), scratch(spark, "laps")
    q = s.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", scratch(spark, "laps-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return out(spark.read.schema(s.schema).parquet(path))


@query(
    "t1_stream_catalog",
    "SELECT session_id, 'wide text' AS format, true AS readable, count(*) AS n_samples, round(sum(value), 2) AS total"
    " FROM fx_samples WHERE channel IN ('click', 'view', 'purchase', 'signup', 'error') GROUP BY session_id",
)
def t1(spark, sf):
    # A log for each session, written by Spark; the stream takes each once, in batches.
    tables = scratch(spark, "tables")
    jobs.stream_catalog(spark, _wide_logs(spark, sf), tables, scratch(spark, "catalog-state"), max_files=100).awaitTermination()
    files = _session(spark.read.parquet(f"{tables}/catalog").select("path", "format", (F.col("status") == "read").alias("readable"), "n_samples"))
    total = _session(spark.read.option("recursiveFileLookup", True).parquet(f"{tables}/samples").select("path", "value")).groupBy("session_id").agg(F.sum("value").alias("total"))
    return out(files.join(total, "session_id"), 2)


@query(
    "t1_stream_laps_and_metadata",
    """WITH c AS (SELECT session_id, tc, row_number() OVER (PARTITION BY session_id ORDER BY tc, event_id) // 20 AS lap FROM ev),
base AS (SELECT session_id, min(tc) AS base, max(tc) AS top, min(ts) AS began FROM ev GROUP BY session_id),
marks AS (SELECT session_id, lap, tc, lag(lap) OVER (PARTITION BY session_id ORDER BY tc) AS before FROM c),
laps AS (SELECT session_id, lap, CASE WHEN before IS NULL THEN 0.0 ELSE tc - base END AS start_tc, top - base AS top FROM marks JOIN base USING (session_id) WHERE before IS NULL OR before <> lap)
SELECT session_id, lap AS lap_num, round(start_tc, 3) + 0.0 AS start_tc, round(coalesce(lead(start_tc) OVER w, top), 3) + 0.0 AS end_tc, strftime(began, '%m/%d/%Y') AS log_date
FROM laps JOIN (SELECT session_id, began FROM base) USING (session_id) WINDOW w AS (PARTITION BY session_id ORDER BY start_tc)""",
)
def t1b(spark, sf):
    # Logs that carry a lap counter and a clock.
    e, w = fx.events(spark, sf), Window.partitionBy("session_id").orderBy("tc", "event_id")
    e = e.withColumn("lap", F.floor(F.row_number().over(w) / 20))
    rows = e.select("session_id", F.concat_ws(",", F.col("tc").cast("string"), F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), F.col("lap").cast("string")).alias("value"), "tc")
    head = F.lit('"Interval"|"ms","Utc"|"ms","LapCount"|""')
    logs, tables = scratch(spark, "lap-logs"), scratch(spark, "lap-tables")
    lines = rows.unionByName(rows.select("session_id").distinct().select("session_id", head.alias("value"), F.lit(-1.0).alias("tc")))
    storage.write_logs(lines.withColumnRenamed("tc", "o"), logs)
    jobs.stream_catalog(spark, logs, tables, scratch(spark, "lap-state"), max_files=200).awaitTermination()
    found = _session(spark.read.parquet(f"{tables}/laps"))
    meta = _session(spark.read.parquet(f"{tables}/metadata")).select("session_id", F.col("metadata")["Log Date"].alias("log_date"))
    return out(found.join(meta, "session_id").select("session_id", "lap_num", "start_tc", "end_tc", "log_date"), 3)
