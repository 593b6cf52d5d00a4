"""Positions and tracks: crossings of a start line, nearest points, turns, segments, matching."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.geo import bearing, cell, lla_to_ecef, mercator
from ..sources.storage import kept, sorted_join
from .distance import PLACES_A_TASK, build_dist_map, resample_lap
from .laps import best_lap


def _by_tc() -> WindowSpec:
    return Window.partitionBy("session_id").orderBy("tc")


def path_bounds(fixes: DataFrame, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """The box around the fixes of each session (or lap)."""
    return fixes.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon", "alt") for n, f in (("min", F.min), ("max", F.max))])


def tile_rollup(fixes: DataFrame, zoom: int) -> DataFrame:
    """Fixes per web-mercator tile."""
    x, y = mercator(F.col("lat"), F.col("lon"))
    n = 2**zoom
    return fixes.groupBy(F.floor(x * n).cast("long").alias("x"), F.floor(y * n).cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n")).withColumn("zoom", F.lit(zoom))


def start_line(samples: DataFrame, lat: str, lon: str) -> DataFrame:
    """A session's start line as the median of two channels."""
    v = F.col("value")
    return samples.filter(F.col("channel").isin(lat, lon)).groupBy("session_id").agg(F.median(F.when(F.col("channel") == lat, v)).alias("lat"), F.median(F.when(F.col("channel") == lon, v)).alias("lon"))


def _dot(a: tuple, b: tuple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def line_crossings(fixes: DataFrame, lines: DataFrame, radius: float = 30.0, min_speed: float = 4.0) -> DataFrame:
    """Times at which each session crosses its start line (``lines``: session_id, lat, lon).

    The line is a plane through the point's vertical. First each step's own direction is the
    plane's normal; crossings within ``radius`` at ``min_speed`` or more then give one normal,
    their sum weighted by speed, with which all steps are judged again. A crossing not after
    the one before is skipped; one at low speed is taken at the next fast step.
    """
    zero = F.lit(0.0)
    ends = lines.select("session_id", *[c.alias(n) for n, c in zip(("sx", "sy", "sz"), lla_to_ecef(F.col("lat"), F.col("lon"), zero), strict=True)], *[c.alias(n) for n, c in zip(("ux", "uy", "uz"), lla_to_ecef(F.col("lat"), F.col("lon"), F.lit(1000.0)), strict=True)])
    at = fixes.select("session_id", "tc", *[c.alias(n) for n, c in zip("xyz", lla_to_ecef(F.col("lat"), F.col("lon"), zero), strict=True)])
    p = at.join(ends, "session_id")
    p = p.select("session_id", "tc", *[(F.col(a) - F.col(f"s{a}")).alias(f"o{a}") for a in "xyz"], *[(F.col(f"u{a}") - F.col(f"s{a}")).alias(f"s{a}") for a in "xyz"])
    p = p.withColumn("tc1", F.lead("tc").over(_by_tc()))
    for a in "xyz":
        p = p.withColumn(f"d{a}", F.lead(f"o{a}").over(_by_tc()) - F.col(f"o{a}"))
    p = p.filter("tc1 IS NOT NULL")
    o, d, s = (tuple(F.col(f"{n}{a}") for a in "xyz") for n in "ods")
    fast = _dot(d, d) > F.pow((F.col("tc1") - F.col("tc")) * (min_speed / 1000), F.lit(2))
    p = p.withColumn("fast", fast)
    for i, a in enumerate("xyz"):
        p = p.withColumn(f"n{a}", _dot(s, s) * d[i] - _dot(s, d) * s[i])

    def picked(df: DataFrame, n: tuple) -> DataFrame:
        t = F.greatest(F.coalesce(F.try_divide(-_dot(n, o), _dot(n, d)), F.lit(math.inf)), F.lit(0.0))
        df = df.withColumn("t", t).withColumn("t0", F.lag("t").over(_by_tc()))
        off = [o[i] + F.col("t") * d[i] for i in range(3)]
        near = sum((x * x for x in off[1:]), off[0] * off[0]) < radius**2
        return df.withColumn("pick", F.coalesce((F.col("t") <= 1) & (F.col("t0") > 1) & near, F.lit(False)))

    own = tuple(F.col(f"n{a}") for a in "xyz")
    first = picked(p, own)
    normal = first.filter("pick AND fast").groupBy("session_id").agg(*[F.sum(f"n{a}").alias(f"m{a}") for a in "xyz"])
    second = picked(p.join(normal, "session_id"), tuple(F.col(f"m{a}") for a in "xyz"))
    # A slow crossing is taken at the next fast step of the session.
    here = F.struct(F.col("tc"), F.col("tc1"), F.col("t"))
    later = Window.partitionBy("session_id").orderBy(F.desc("tc")).rowsBetween(Window.unboundedPreceding, 0)
    second = second.withColumn("use", F.coalesce(F.last(F.when(F.col("fast"), here), ignorenulls=True).over(later), here)).filter("pick")
    marks = second.select("session_id", "tc", (F.col("use.tc") + F.col("use.t") * (F.col("use.tc1") - F.col("use.tc"))).alias("at"))
    # The skip rule is an ordered fold over a session's crossings (tens).
    folded = marks.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("tc", "at"))).alias("m"))
    kept = F.aggregate("m", F.array().cast("array<double>"), lambda acc, m: F.when(m["tc"] > F.coalesce(F.element_at(F.concat(F.array(F.lit(0.0)), acc), -1), F.lit(0.0)), F.concat(acc, F.array(m["at"]))).otherwise(acc))
    return folded.select("session_id", F.posexplode(kept).alias("crossing", "tc"))


def laps_from_gps(fixes: DataFrame, lines: DataFrame) -> DataFrame:
    """Laps between crossings, from 0 to the session's last fix."""
    x = line_crossings(fixes, lines).groupBy("session_id").agg(F.array_sort(F.collect_list("tc")).alias("m"))
    ends = fixes.groupBy("session_id").agg(F.max("tc").alias("end"))
    c = ends.join(x, "session_id", "left").select("session_id", F.concat(F.array(F.lit(0.0)), F.coalesce("m", F.array().cast("array<double>")), F.array("end")).alias("c"))
    return c.select("session_id", "c", F.posexplode(F.slice("c", 1, F.size("c") - 1)).alias("lap_num", "start_tc")).select("session_id", "lap_num", "start_tc", F.get("c", F.col("lap_num") + 1).alias("end_tc"))


def segments(track_points: DataFrame) -> DataFrame:
    """Each track's segments, from (track_id, seq, lat, lon)."""
    w = Window.partitionBy("track_id").orderBy("seq")
    nxt = track_points.withColumn("lat1", F.lead("lat").over(w)).withColumn("lon1", F.lead("lon").over(w))
    return nxt.filter("lat1 IS NOT NULL").select("track_id", "seq", "lat", "lon", "lat1", "lon1")


#: Metres in which nearest_on_track looks first; and no two places on earth are further apart than that.
FIRST_LOOK, FURTHEST = 30.0, 20_100_000.0
#: Sizes of cells in metres, each eight times the one before, up to one that holds all.
LEVELS = [50.0 * 8**i for i in range(6)] + [FURTHEST]
#: Points beyond the first look that one task gets.
FAR_A_TASK = 20_000
#: Rows of cells that are sent to all tasks: some 25 MB.
CELLS_TO_ALL = 250_000
_DEGREE = 111_000.0
#: Degrees of longitude to one of latitude in a cell: up to 66 degrees north or south it stays at least as wide as high.
_WIDER = 2.5


def nearest_on_track(points: DataFrame, track_points: DataFrame, max_dist: float | None = None) -> DataFrame:
    """Per point (session_id, tc, lat, lon, track_id) the closest segment of its track, within ``max_dist`` metres if given.

    Adds idx (segment and part of it) and off (metres). Points that have no segment within FIRST_LOOK meet a pyramid of
    cells: the smallest level whose cells around a point hold some of its track bounds how far the closest
    segment can be, and the level above holds all segments within that. So a far point meets few, wide cells,
    and a segment stands in cells of those levels only that its track's points need. Of a track without
    segments, or beyond ``max_dist``, both are NULL.
    """
    if max_dist is not None:
        return _nearest_within(points, track_points, min(max_dist, FURTHEST))
    found = kept(_nearest_within(points, track_points, FIRST_LOOK), "near")
    far = found.filter("off IS NULL").select(*points.columns)
    # Few bytes, but each point meets all segments of wide cells: tasks are as many as that work needs.
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-far.count() // FAR_A_TASK))
    seg = segments(track_points)
    sizes = F.array(*[F.lit(x) for x in LEVELS])
    every = lambda df: df.select("*", F.posexplode(sizes).alias("level", "size"))
    own = ["session_id", "tc", "track_id"]
    occupied = _to_all(_in_cells(every(seg)).select("track_id", "level", "cx", "cy").distinct().withColumn("_held", F.col("level")))
    # Points are few bytes on disk, but many rows: they carry their columns along, since a join back to them would broadcast them all.
    far = _own_cell(every(far.repartition(tasks, *own).withColumn("_point", F.monotonically_increasing_id()))).join(occupied, ["track_id", "level", "cx", "cy"], "left")
    far = far.groupBy(*own, "_point").agg(*[F.first(c).alias(c) for c in points.columns if c not in own], F.min("_held").alias("level"))
    # The cells' segments lie within about five cells and a segment's length.
    m = math.pi / 180 * 6371008.8
    length = F.sqrt(F.pow((F.col("lat1") - F.col("lat")) * m, F.lit(2)) + F.pow((F.col("lon1") - F.col("lon")) * m, F.lit(2)))
    longest = seg.groupBy("track_id").agg(F.max(length).alias("longest"))
    least = F.least(F.size(F.filter(sizes, lambda x: x < F.col("longest") / 2.5)), F.lit(len(LEVELS) - 1))
    level = F.when(F.col("level").isNotNull(), F.least(F.greatest("level", least) + 1, F.lit(len(LEVELS) - 1)))
    far = kept(far.join(longest, "track_id", "left").withColumn("level", level.cast("int")).select(*points.columns, "level"), "far")
    needed = far.filter("level IS NOT NULL").select("track_id", "level").distinct()
    seg = _to_all(_in_cells(seg.join(needed, "track_id").withColumn("size", F.get(sizes, F.col("level")))))
    far = _own_cell(far.repartition(tasks, *own).withColumn("size", F.get(sizes, F.col("level"))))
    best = _closest_of_each(far, seg, ["track_id", "level", "cx", "cy"], points.columns)
    return found.filter("off IS NOT NULL").unionByName(best)


def _in_cells(seg: DataFrame) -> DataFrame:
    """Segments in each cell of ``size`` metres that their box reaches, and in those around."""
    seg = seg.withColumn("_h", F.col("size") / _DEGREE)

    def box(a: str, b: str, width: Column) -> Column:
        lo, hi = F.floor(F.least(a, b) / width) - 1, F.floor(F.greatest(a, b) / width) + 1
        return F.explode(F.sequence(lo.cast("long"), hi.cast("long")))

    return seg.withColumn("cy", box("lat", "lat1", F.col("_h"))).withColumn("cx", box("lon", "lon1", F.col("_h") * _WIDER)).drop("_h", "size")


def _to_all(cells: DataFrame) -> DataFrame:
    """``cells``, written; if they are few they go to all tasks, so that points stay where they were dealt to: wide cells hold many points each.

    By estimates alone such points were shuffled by their cell, and cells found to be small only after that.
    """
    cells = kept(cells, "cells")
    return F.broadcast(cells) if cells.count() <= CELLS_TO_ALL else cells


def _own_cell(points: DataFrame) -> DataFrame:
    high = F.col("size") / _DEGREE
    return points.withColumn("cy", F.floor(F.col("lat") / high).cast("long")).withColumn("cx", F.floor(F.col("lon") / (high * _WIDER)).cast("long"))


def _met(points: DataFrame, seg: DataFrame, cells: list[str], how: str = "inner") -> DataFrame:
    """Points with each segment that they share a cell with, its seq, part t and distance off."""
    seg = seg.select("seq", *[F.col(c).alias(f"s_{c}") for c in ("lat", "lon", "lat1", "lon1")], *cells)
    return _offsets(points.join(seg, cells, how))


def _offsets(pairs: DataFrame) -> DataFrame:
    """Pairs of a point and a segment (s_lat, s_lon, s_lat1, s_lon1) with its part t and distance off."""
    m = math.pi / 180 * 6371008.8
    k = F.cos(F.radians("lat"))
    ax, ay = (F.col("s_lon") - F.col("lon")) * k * m, (F.col("s_lat") - F.col("lat")) * m
    dx, dy = (F.col("s_lon1") - F.col("s_lon")) * k * m, (F.col("s_lat1") - F.col("s_lat")) * m
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(-(ax * dx + ay * dy), dx * dx + dy * dy), F.lit(0.0))))
    x = pairs.withColumn("t", t)
    return x.withColumn("off", F.sqrt(F.pow(ax + F.col("t") * dx, F.lit(2)) + F.pow(ay + F.col("t") * dy, F.lit(2))))


def _closest(points: DataFrame, seg: DataFrame, cells: list[str], within: float = FURTHEST * 2) -> DataFrame:
    """session_id, tc, track_id, idx and off of the closest segment that a point shares a cell with."""
    return _least(_met(points, seg, cells).filter(F.col("off") <= within))


def _least(x: DataFrame) -> DataFrame:
    best = x.groupBy("session_id", "tc", "track_id").agg(F.min(F.struct("off", (F.col("seq") + F.col("t")).alias("idx"))).alias("b"))
    return best.select("session_id", "tc", "track_id", "b.idx", "b.off")


def _closest_of_each(points: DataFrame, seg: DataFrame, cells: list[str], columns: list[str], within: float = FURTHEST * 2) -> DataFrame:
    """``columns`` of ``points``, dealt by session, tc and track, with idx and off of the closest segment that each shares a cell with; NULL if there is none.

    A point's pairs are reduced in the task that the point was dealt to, and aren't joined with points again.
    """
    x = _met(points.withColumn("_point", F.monotonically_increasing_id()), seg, cells, "left")
    near = F.when(F.col("off") <= within, F.struct("off", (F.col("seq") + F.col("t")).alias("idx")))
    own = ["session_id", "tc", "track_id"]
    best = x.groupBy(*own, "_point").agg(*[F.first(c).alias(c) for c in columns if c not in own], F.min(near).alias("_b"))
    return best.select(*columns, F.col("_b.idx").alias("idx"), F.col("_b.off").alias("off"))


def _nearest_within(points: DataFrame, track_points: DataFrame, max_dist: float) -> DataFrame:
    """The closest segment within ``max_dist``, by cells at least that wide; points stay in the tasks that they were dealt to."""
    size = F.lit(max(max_dist, LEVELS[0]))
    return _closest_of_each(_own_cell(points.withColumn("size", size)), _in_cells(segments(track_points).withColumn("size", size)), ["track_id", "cx", "cy"], points.columns, max_dist)


def nearest_on_own_track(points: DataFrame, track_points: DataFrame) -> DataFrame:
    """J7 where there are many tracks with few points each: session_id, tc, track_id, idx and off.

    Points meet their track's segments by track alone, and are compared by boxes of FIRST_LOOK; no segment is put in cells, and tracks that are
    dealt by track_id stay where they are. Points that find nothing so meet all of their track.
    """
    seg = segments(track_points)
    high = FIRST_LOOK / _DEGREE
    wide = high / F.greatest(F.cos(F.radians("lat")), F.lit(1e-6))
    near = seg.select("track_id", "seq", F.struct("lat", "lon", "lat1", "lon1").alias("_s"))
    within = lambda c, margin: (F.col(c) >= F.least(f"_s.{c}", f"_s.{c}1") - margin) & (F.col(c) <= F.greatest(f"_s.{c}", f"_s.{c}1") + margin)
    pairs = points.alias("p").join(sorted_join(near).alias("s"), (F.col("p.track_id") == F.col("s.track_id")) & within("lat", F.lit(high)) & within("lon", wide))
    x = pairs.select("session_id", "tc", "p.track_id", "lat", "lon", "seq", *[F.col(f"_s.{c}").alias(f"s_{c}") for c in ("lat", "lon", "lat1", "lon1")])
    found = kept(_least(_offsets(x).filter(F.col("off") <= FIRST_LOOK)), "near_own")
    far = points.join(sorted_join(found.select("session_id", "tc", "track_id")), ["session_id", "tc", "track_id"], "left_anti")
    return found if far.isEmpty() else found.unionByName(_closest(far, seg, ["track_id"]))


def match_track(paths: DataFrame, track_points: DataFrame, max_off: float = 15.0, increasing: float = 0.9) -> DataFrame:
    """The stored track that each session's path (session_id, tc, lat, lon) runs along, if any.

    Candidates share a position cell with the path. All points must lie within ``max_off`` and more
    than ``increasing`` of the steps go forward; of several, the one with the smallest largest offset.
    """
    own = paths.select("session_id", cell(F.col("lat")).alias("cy"), cell(F.col("lon")).alias("cx")).distinct()
    theirs = track_points.select("track_id", cell(F.col("lat")).alias("cy"), cell(F.col("lon")).alias("cx")).distinct()
    pairs = own.join(theirs, ["cx", "cy"]).select("session_id", "track_id").distinct()
    near = nearest_on_track(paths.join(pairs, "session_id"), track_points, max_off)
    w = Window.partitionBy("session_id", "track_id").orderBy("tc")
    near = near.withColumn("up", (F.col("idx") > F.lag("idx").over(w)).cast("double"))
    fit = near.groupBy("session_id", "track_id").agg(F.max("off").alias("off"), F.avg("up").alias("up"), F.bool_and(F.col("off").isNotNull()).alias("all"))
    fit = fit.filter((F.col("all")) & (F.col("off") < max_off) & (F.col("up") > increasing))
    return fit.groupBy("session_id").agg(F.min_by("track_id", F.struct("off", "track_id")).alias("track_id"), F.min("off").alias("off"))


def turn_rate(path: DataFrame, spacing_m: float = 1.0) -> DataFrame:
    """Signed turn rate along a path (track_id, seq, lat, lon, speed), sampled every ``spacing_m`` metres.

    Bearing over 4 m, its change over 10 m brought to ±180, times the speed half-way, then a sliding mean
    of four; each at the middle of what it is taken from. NULL where the path is too short for that.
    """
    w = Window.partitionBy("track_id").orderBy("seq")
    a, b = max(1, round(4 / spacing_m)), max(1, round(10 / spacing_m))
    half = a // 2 + b // 2
    x = path.withColumn("brg", bearing(F.col("lat"), F.col("lon"), F.lead("lat", a).over(w), F.lead("lon", a).over(w)))
    change = F.pmod(F.lead("brg", b).over(w) - F.col("brg") + 180, F.lit(360.0)) - 180
    four = w.rowsBetween(-half - 1, 2 - half)
    x = x.withColumn("raw", change * F.lead("speed", half).over(w))
    x = x.withColumn("rate", F.when(F.count("raw").over(four) == 4, F.avg("raw").over(four)))
    return x.select("track_id", "seq", "lat", "lon", "rate")


_RUN = "struct<kind:string,a:bigint,b:bigint,cross:bigint>"


def _folded(runs: Column, lefts: Column | None, decide: Callable[[Column, Column, Column], tuple[Column, Column]]) -> Column:
    """Runs (an array) merged from the last to the first, in one pass.

    ``decide`` says of a run, the kind of the run before it (from ``lefts``, if given) and the run that follows whether the three become
    one, or else where the two around it meet in its place (null: it stays). The first two runs and the last are kept.
    """
    left = lambda i: F.lit(None).cast("string") if lefts is None else F.get(lefts, i)
    numbered = F.transform(runs, lambda r, i: F.struct(r.alias("r"), i.alias("i"), left(i).alias("left")))
    # What has been done, in order, and where the run to come ends if a later one changed that.
    start = F.struct(F.array().cast(f"array<{_RUN}>").alias("done"), F.lit(None).cast("bigint").alias("end"))

    def step(acc: Column, x: Column) -> Column:
        own = F.struct(x["r"]["kind"].alias("kind"), x["r"]["a"].alias("a"), F.coalesce(acc["end"], x["r"]["b"]).alias("b"), x["r"]["cross"].alias("cross"))
        right, rest = F.get(acc["done"], F.lit(0)), F.slice(acc["done"], 2, F.greatest(F.size(acc["done"]) - 1, F.lit(0)))
        one, meet = decide(own, x["left"], right)
        inner = (x["i"] > 1) & (F.size(acc["done"]) > 0)
        moved = F.struct(right["kind"].alias("kind"), meet.alias("a"), right["b"].alias("b"), right["cross"].alias("cross"))
        joined = F.struct(rest.alias("done"), right["b"].alias("end"))
        halved = F.struct(F.concat(F.array(moved), rest).alias("done"), meet.alias("end"))
        stays = F.struct(F.concat(F.array(own), acc["done"]).alias("done"), F.lit(None).cast("bigint").alias("end"))
        return F.when(inner & one, joined).when(inner & meet.isNotNull(), halved).otherwise(stays)

    return F.aggregate(F.reverse(numbered), start, step, lambda acc: acc["done"])


def segment_track(turns: DataFrame, limit: float = 150.0, min_straight: float = 25.0, min_turn: float = 10.0, spacing_m: float = 1.0) -> DataFrame:
    """Segments of each track (track_id, seq, rate): (seg, name, kind, start_seq, end_seq).

    Runs above ``limit`` are right turns, below minus it left turns, else straights. Of the runs but the first
    two and the last, from the end: straights under 25 m between turns of one side join them; between
    opposite turns they are split where the rate first changes its sign, and stay if it doesn't; then
    turns under 10 m go to the run before, with the run after. Rows without a rate are left out. A track's
    runs, tens of them, are one array; two folds over it merge them.
    """
    turns = turns.filter("rate IS NOT NULL")
    kind = F.when(F.col("rate") > limit, "R").when(F.col("rate") < -limit, "L").otherwise("S")
    w = Window.partitionBy("track_id").orderBy("seq")
    x = turns.withColumn("kind", kind).withColumn("new", (F.col("kind") != F.coalesce(F.lag("kind").over(w), F.lit(""))).cast("int"))
    x = x.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    crossed = (F.col("new") == 0) & ((F.col("rate") > 0) != (F.lag("rate").over(w) > 0))
    x = x.withColumn("cross", F.when(crossed, F.col("seq")))
    runs = x.groupBy("track_id", "run").agg(F.first("kind").alias("kind"), F.min("seq").alias("a"), (F.max("seq") + 1).alias("b"), F.min("cross").alias("cross"))
    runs = runs.withColumn("left", F.lag("kind").over(Window.partitionBy("track_id").orderBy("run")))
    tracks = runs.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("run", "left", F.struct("kind", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("cross").cast("long").alias("cross")).alias("r")))).alias("all"))
    length = lambda r: (r["b"] - r["a"]) * F.lit(float(spacing_m))

    def short_straight(own: Column, left: Column, right: Column) -> tuple[Column, Column]:
        short = (own["kind"] == "S") & (length(own) < min_straight)
        return short & (left == right["kind"]), F.when(short, own["cross"])

    def short_turn(own: Column, left: Column, right: Column) -> tuple[Column, Column]:
        return (own["kind"] != "S") & (length(own) < min_turn), F.lit(None).cast("bigint")

    tracks = tracks.select("track_id", F.transform("all", lambda x: x["r"].cast(_RUN)).alias("r"), F.col("all.left").alias("lefts"))
    tracks = tracks.select("track_id", _folded(F.col("r"), F.col("lefts"), short_straight).alias("r"))
    tracks = tracks.select("track_id", _folded(F.col("r"), None, short_turn).alias("r"))
    turns_in = lambda part: F.size(F.filter(part, lambda r: r["kind"] != "S"))
    rows = tracks.select("track_id", "r", turns_in(F.col("r")).alias("total"), F.posexplode("r").alias("seg", "own"))
    rows = rows.withColumn("turn", turns_in(F.slice("r", 1, F.col("seg")))).withColumn("is_turn", F.col("own.kind") != "S")
    after = F.when(F.col("turn") > 0, F.col("turn")).otherwise(F.col("total"))
    straight = F.concat(F.lit("Str "), after.cast("string"), F.lit("-"), (F.pmod(F.col("turn"), F.greatest("total", F.lit(1))) + 1).cast("string"))
    name = F.when(F.col("is_turn"), F.concat(F.lit("Turn "), (F.col("turn") + 1).cast("string"))).otherwise(straight)
    shown = F.when(F.col("own.kind") == "R", "Right").when(F.col("own.kind") == "L", "Left").otherwise("Straight")
    return rows.select("track_id", F.col("seg").cast("long").alias("seg"), name.alias("name"), shown.alias("kind"), F.col("own.a").alias("start_seq"), F.col("own.b").alias("end_seq"))


def reinsert_laps(fixes: DataFrame, speed: DataFrame, lines: DataFrame, length: DataFrame, grid_ms: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Laps cut again at a stored track's start line (``lines``), and the distance map scaled to its ``length``.

    Sessions that never cross the line keep one lap from 0 to their end.
    """
    laps = kept(laps_from_gps(fixes, lines), "laps")  # the map looks at them several times
    return laps, build_dist_map(speed, laps, grid_ms, length)


def best_lap_path(samples: DataFrame, laps: DataFrame, dist_map: DataFrame, lat: str, lon: str, speed: str, alt: str | None = None, step_m: float = 1.0, grid_ms: float = 10.0) -> DataFrame:
    """The best lap (A6) of each session of at least three laps as a closed path every ``step_m`` metres.

    ``laps`` have start_dist and end_dist. Columns: track_id (the session), seq, lat, lon, alt (0 without the channel), speed.
    """
    laps = kept(laps, "laps")
    many = laps.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("session_id"))).filter("_n >= 3").drop("_n")
    best = kept(best_lap(many).select("session_id", "lap_num").join(sorted_join(laps), ["session_id", "lap_num"]), "best_laps")
    names = [c for c in (lat, lon, speed, alt) if c]
    wide = resample_lap(samples, best, dist_map, names, step_m, grid_ms)
    rows = wide.select(F.col("session_id").alias("track_id"), F.col("i").alias("seq"), F.col(f"`{lat}`").alias("lat"), F.col(f"`{lon}`").alias("lon"), (F.col(f"`{alt}`") if alt else F.lit(0.0)).alias("alt"), F.col(f"`{speed}`").alias("speed"))
    rows = rows.filter("lat IS NOT NULL AND lon IS NOT NULL")
    return close_loop(rows)


def build_track(path: DataFrame, spacing_m: float = 1.0, point_m: float = 10.0, limit: float = 150.0) -> tuple[DataFrame, DataFrame]:
    """A track's points and segments from its best lap's path (track_id, seq, lat, lon, speed), evenly spaced by distance.

    Points stand every ``point_m`` metres. Segments carry their start's position, and its distance along the
    points (J7; O3 orders by it).
    """
    every = max(1, round(point_m / spacing_m))
    parts = kept(segment_track(turn_rate(path, spacing_m), limit, spacing_m=spacing_m), "parts")
    # Of a path, which may be dear to make and large to write, its points and the starts of its parts are kept. They meet
    # by track alone, so that a path dealt by track stays where it is.
    starts = parts.groupBy("track_id").agg(F.collect_set("start_seq").alias("starts"))
    is_point, is_start = F.pmod(F.col("seq"), F.lit(every)) == 0, F.coalesce(F.array_contains("starts", F.col("seq").cast("long")), F.lit(False))
    places = kept(path.join(sorted_join(starts), "track_id", "left").select("track_id", "seq", "lat", "lon", is_point.alias("is_point"), is_start.alias("is_start")).filter("is_point OR is_start"), "track_places")
    points = places.filter("is_point").select("track_id", (F.col("seq") / every).cast("long").alias("seq"), "lat", "lon", (F.col("seq") * F.lit(float(spacing_m))).alias("dist"))
    marks = kept(parts.join(sorted_join(places.filter("is_start").select("track_id", F.col("seq").alias("start_seq"), "lat", "lon")), ["track_id", "start_seq"]), "marks")
    tasks = max(int(path.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-points.count() // PLACES_A_TASK))
    found = nearest_on_own_track(marks.select(F.col("track_id").alias("session_id"), F.col("seg").alias("tc"), "track_id", "lat", "lon"), points.repartition(tasks, "track_id"))
    return points, marks.join(sorted_join(found.select("track_id", F.col("tc").alias("seg"), (F.col("idx") * F.lit(float(every * spacing_m))).alias("dist"))), ["track_id", "seg"], "left")


def close_loop(path: DataFrame, within: float = 20.0) -> DataFrame:
    """Paths (track_id, seq, lat, lon, ...) whose ends lie within ``within`` metres, closed: the gap is spread evenly along."""
    w = Window.partitionBy("track_id").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gaps = {c: F.last(c).over(whole) - F.first(c).over(whole) for c in ("lat", "lon")}
    x = path.select("*", (F.count(F.lit(1)).over(whole) - 1).alias("_n"), (F.row_number().over(w) - 1).alias("_i"), *[gap.alias(f"_{c}") for c, gap in gaps.items()])
    m = math.pi / 180 * 6371008.8
    near = F.sqrt(F.pow(F.col("_lat") * m, F.lit(2)) + F.pow(F.col("_lon") * m * F.cos(F.radians("lat")), F.lit(2))) < within
    part = F.coalesce(F.try_divide("_i", "_n"), F.lit(0.0))
    closed = {c: F.when(near, F.col(c) - F.col(f"_{c}") * part).otherwise(F.col(c)).alias(c) for c in ("lat", "lon")}
    return x.select("track_id", "seq", closed["lat"], closed["lon"], *[c for c in path.columns if c not in ("track_id", "seq", "lat", "lon")])


def markers_by_distance(markers: DataFrame) -> DataFrame:
    """O3: markers of each track with their place in order of distance; a missing distance is 0."""
    w = Window.partitionBy("track_id").orderBy(F.coalesce("dist", F.lit(0.0)), "name")
    return markers.withColumn("place", F.row_number().over(w))
