"""Distance along a session: integrated speed, and lookups between time and distance.

The map is defined on a fixed grid of time: distance at grid point k is the sum, up to and
including k, of speed times step. It is held in closed form, a row for each stretch between
two speed samples or lap boundaries; within one, speed is linear, so sums are quadratic in k.
A session of two hours has 720 000 grid points but only as many rows as speed samples.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import kept, sorted_join
from .align import asof, assign_laps, interp_join, linear
from .buckets import BUCKET_MS, bucket, edges, first_of, ignoring_nulls, running, within


#: Width of a bucket of distance, in metres.
BUCKET_M = 30_000.0


def micrometres(dist: Column) -> Column:
    """Distances as they are compared: to six decimals, so that the order in which sums were taken decides nothing."""
    return F.round(dist, 6)


def beyond(a: Column, b: Column) -> Column:
    """Whether ``a`` is more than ``b`` in micrometres; decimals are only made where that depends on them."""
    return (a > b + 2e-6) | ((a > b - 2e-6) & (micrometres(a) > micrometres(b)))


def build_dist_map(speed: DataFrame, laps: DataFrame, grid_ms: float = 10.0, expected: DataFrame | None = None, width: float = BUCKET_MS) -> DataFrame:
    """``speed`` (session_id, tc ms, value m/s) over ``laps`` to the map's stretches.

    Inner laps (neither first nor last) within 5 % (in micrometres) of the inner laps' median distance, or of
    ``expected`` (session_id, length), are scaled to it. Columns: k0, k1 (grid points [k0, k1)),
    v (speed at k0) and slope (per grid point), f (metres per unit of speed, scaled), before (distance
    ahead of k0), next_step (metres that k1 adds), k_last (the session's last grid point).

    Sums run on two levels: within the buckets of a session (``width`` ms), and over the totals of
    each bucket and lap, which are few.
    """
    g = F.lit(float(grid_ms))
    by = Window.partitionBy("session_id")
    numbered = laps.withColumn("i", F.row_number().over(by.orderBy("start_tc"))).withColumn("n_laps", F.count(F.lit(1)).over(by))
    inner = ((F.col("i") > 1) & (F.col("i") < F.col("n_laps"))).alias("inner")
    bound = numbered.select("session_id", F.rint(F.col("start_tc") / g).cast("long").alias("k"), F.struct(F.rint(F.col("start_tc") / g).cast("double").alias("_on"), F.col("lap_num").cast("int").alias("lap_num"), inner).alias("lap"))
    ends = laps.groupBy("session_id").agg(F.ceil(F.max("end_tc") / g).cast("long").alias("k_end"))
    tc = F.col("tc").cast("double")
    rows = speed.select("session_id", F.ceil(tc / g).cast("long").alias("k"), F.struct(tc.alias("_on"), F.col("value").alias("v")).alias("s"))
    rows = rows.unionByName(bound, allowMissingColumns=True).unionByName(ends.select("session_id", F.lit(0).cast("long").alias("k")), allowMissingColumns=True)
    rows = rows.withColumn("_bucket", bucket(F.col("k") * g, width)).withColumn("_side", F.lit(0)).withColumn("at", F.struct(F.col("k").cast("double").alias("_on"), "k"))
    # Ahead of a bucket stand its session's end and first speed as well.
    firsts = speed.filter("value IS NOT NULL").groupBy("session_id").agg(F.min(F.struct(tc.alias("tc"), (-F.col("value")).alias("v"))).alias("x")).select("session_id", (-F.col("x.v")).alias("first_value"))
    known = edges(rows, ("session_id",), ["s", "lap", "at"]).join(ends, "session_id").join(firsts, "session_id").withColumn("k", F.when(F.col("_side") > 0, F.col("at.k")))
    rows = rows.drop("at").unionByName(known.drop("at"), allowMissingColumns=True)
    # Stretches are used twice; with the filters that joins would infer on one side only, both uses share their shuffle.
    rows = rows.filter("session_id IS NOT NULL AND _bucket IS NOT NULL").repartition("session_id", "_bucket")
    rows = rows.groupBy("session_id", "_bucket", "_side", "k").agg(F.max("s").alias("s"), first_of("s").alias("s_first"), F.max("lap").alias("lap"), F.max("k_end").alias("k_end"), F.max("first_value").alias("first_value"))
    w = within(("session_id",), "k")
    so_far = [F.max(c).over(running(w)).alias(c) for c in ("s", "lap", "k_end", "first_value")]
    seg = rows.select("session_id", "_bucket", "_side", F.col("k").alias("k0"), *so_far, ignoring_nulls("s_first", ["session_id", "_bucket"], ["_side", "k"]).alias("next"), F.lead("k").over(w).alias("k1"))
    seg = seg.filter("_side = 0 AND k0 < k_end").withColumn("k1", F.least(F.coalesce("k1", "k_end"), F.col("k_end")))
    span = F.col("next._on") - F.col("s._on")
    slope = F.when(F.col("s").isNull() | F.col("next").isNull() | (span == 0), 0.0).otherwise(F.try_divide(F.col("next.v") - F.col("s.v"), span) * g)
    seg = seg.withColumn("slope", slope).withColumn("v", F.when(F.col("s").isNull(), F.col("first_value")).otherwise(F.col("s.v") + F.col("slope") * (F.col("k0") * g - F.col("s._on")) / g))
    n = F.col("k1") - F.col("k0")
    seg = seg.select("session_id", "_bucket", F.col("lap.lap_num").alias("lap_num"), F.col("lap.inner").alias("inner"), "k0", "k1", "k_end", "v", "slope", ((n * F.col("v") + F.col("slope") * n * (n - 1) / 2) * g / 1000).alias("raw"))

    # The stretches of one lap in one bucket are a run: few to a session, whose lengths and sums are windows over it.
    runs = seg.groupBy("session_id", "_bucket", "lap_num").agg(F.sum("raw").alias("raw"), F.first("inner").alias("inner"), F.min("k0").alias("k0"), F.min_by("v", "k0").alias("v"))
    runs = runs.repartition("session_id")
    in_lap, in_turn = Window.partitionBy("session_id", "lap_num"), by.orderBy("k0")
    runs = runs.withColumn("len", F.when(F.col("inner"), F.sum("raw").over(in_lap))).withColumn("once", F.row_number().over(in_lap.orderBy("k0")) == 1)
    if expected is None:
        runs = runs.withColumn("length", F.median(F.when(F.col("once"), F.col("len"))).over(by))
    else:
        runs = runs.join(expected.select("session_id", "length"), "session_id", "left")
    # Where speed is constant lengths are multiples of it, and 19 or 21 of 20 are five percent exactly: no rounding error decides that.
    near = (F.col("length") != 0) & ~beyond(F.abs(F.col("len") - F.col("length")), 0.05 * F.abs(F.col("length")))
    runs = runs.withColumn("factor", F.coalesce(F.when(near, F.try_divide("length", "len")), F.lit(1.0)))
    ahead = F.coalesce(F.sum(F.col("factor") * F.col("raw")).over(in_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    follows = F.lead(F.col("factor") * F.col("v") * g / 1000).over(in_turn)
    runs = runs.select("session_id", "_bucket", F.struct("lap_num", "factor", ahead.alias("before"), follows.alias("next_step")).alias("run"))
    runs = runs.groupBy("session_id", "_bucket").agg(F.collect_list("run").alias("runs"))
    seg = seg.join(runs, ["session_id", "_bucket"]).withColumn("run", F.try_element_at(F.filter("runs", lambda x: x.lap_num.eqNullSafe(F.col("lap_num"))), F.lit(1)))
    in_run = Window.partitionBy("session_id", "_bucket", "lap_num").orderBy("k0")
    local = F.coalesce(F.sum("raw").over(in_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    f = F.col("run.factor") * g / 1000
    return seg.select("session_id", "lap_num", "k0", "k1", "v", "slope", f.alias("f"), (F.col("run.before") + F.col("run.factor") * local).alias("before"), F.coalesce(F.lead("v").over(in_run) * f, F.col("run.next_step")).alias("next_step"), (F.col("k_end") - 1).alias("k_last"))


def _sum_to(k: Column) -> Column:
    """Distance at grid point k of the stretch in the row."""
    m = k - F.col("k0") + 1
    return F.col("before") + F.col("f") * (m * F.col("v") + F.col("slope") * m * (m - 1) / 2)


def _step_at(k: Column) -> Column:
    """Metres that grid point k adds: in the row's stretch, or the first of the next."""
    own = F.col("f") * (F.col("v") + F.col("slope") * (k - F.col("k0")))
    return F.when(k < F.col("k1"), own).otherwise(F.coalesce("next_step", F.lit(0.0)))


_CARRY = ("k0", "k1", "v", "slope", "f", "before", "next_step", "k_last")


def time_to_dist(points: DataFrame, dist_map: DataFrame, grid_ms: float = 10.0, name: str = "dist") -> DataFrame:
    """Distance at each point's tc, linear between grid points, clamped at both ends."""
    m = dist_map.withColumn("k", F.col("k0").cast("double"))
    x = points.withColumn("k", F.greatest(F.floor(F.col("tc") / grid_ms), F.lit(0)).cast("double"))
    found = asof(x, m, ("session_id",), "k", _CARRY, prefix="m_", width=BUCKET_MS / grid_ms).select(*points.columns, "k", *[F.col(f"m_{c}").alias(c) for c in _CARRY])
    k = F.least(F.col("k"), F.col("k_last").cast("double"))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("tc") / grid_ms - k))
    dist = _sum_to(k) + F.when(k >= F.col("k_last"), 0.0).otherwise(part * _step_at(k + 1))
    return found.select(*points.columns, dist.alias(name))


def _times(found: DataFrame, columns: list[str], grid_ms: float, name: str) -> DataFrame:
    """``columns`` of rows with a dist and the stretch that it lies in, and the time there."""
    # m points of the stretch reach the distance: solve f*(m*v + slope*m*(m-1)/2) = dist - before.
    need = (F.col("dist") - F.col("before")) / F.col("f")
    a, b = F.col("slope") / 2, F.col("v") - F.col("slope") / 2
    disc = F.sqrt(F.greatest(b * b + 4 * a * need, F.lit(0.0)))
    guess = F.when(F.abs(a) < 1e-12, F.try_divide(need, b)).otherwise(F.try_divide(2 * need, b + disc))
    still = (F.col("v") == 0) & (F.col("slope") == 0)
    n = (F.col("k1") - F.col("k0")).cast("double")
    m_real = F.when(still, n).otherwise(F.greatest(F.lit(1.0), F.least(F.floor(F.coalesce(guess, F.lit(1.0))).cast("double"), n)))
    found = found.withColumn("_k", m_real + F.col("k0") - 1)
    k, dist = F.col("_k"), F.col("dist")
    k = F.when(beyond(_sum_to(k), dist), F.greatest(k - 1, F.col("k0").cast("double"))).when((k + 1 < F.col("k1")) & ~beyond(_sum_to(k + 1), dist), k + 1).otherwise(k)
    found = found.withColumn("_k", k)
    k = F.col("_k")
    step = _step_at(k + 1)
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("dist") - _sum_to(k), step), F.lit(0.0))))
    tc = F.when(k >= F.col("k_last"), F.col("k_last") * F.lit(float(grid_ms))).otherwise((k + part) * grid_ms)
    return found.select(*columns, F.when(F.col("k0").isNull(), 0.0).otherwise(tc).alias(name))


def dist_to_time(points: DataFrame, dist_map: DataFrame, grid_ms: float = 10.0, name: str = "tc") -> DataFrame:
    """Time at each point's dist, the inverse of time_to_dist where speed is above zero.

    A distance at which the session stood still gives the last grid point of the standstill. Distances are compared in micrometres.
    """
    m = dist_map.withColumn("at", micrometres(F.col("before") + F.col("f") * F.col("v")))
    x = points.withColumn("at", micrometres(F.col("dist").cast("double")))
    found = asof(x, m, ("session_id",), "at", _CARRY, prefix="m_", width=BUCKET_M).select(*points.columns, *[F.col(f"m_{c}").alias(c) for c in _CARRY])
    return _times(found, points.columns, grid_ms, name)


def dist_grid(dist_map: DataFrame, grid_ms: float = 10.0) -> DataFrame:
    """Every grid point's distance: (session_id, tc, dist). Large; for tests and small sessions."""
    x = dist_map.withColumn("k", F.explode(F.sequence("k0", F.col("k1") - 1)))
    return x.select("session_id", (F.col("k") * F.lit(float(grid_ms))).alias("tc"), _sum_to(F.col("k")).alias("dist"))


def with_lap_distances(laps: DataFrame, dist_map: DataFrame, grid_ms: float = 10.0) -> DataFrame:
    """``laps`` with start_dist and end_dist."""
    marks = laps.select("session_id", "lap_num", F.explode(F.array(F.struct(F.lit("start").alias("side"), F.col("start_tc").alias("tc")), F.struct(F.lit("end").alias("side"), F.col("end_tc").alias("tc")))).alias("x")).select("session_id", "lap_num", "x.*")
    d = time_to_dist(marks, dist_map, grid_ms).groupBy("session_id", "lap_num").agg(F.max(F.when(F.col("side") == "start", F.col("dist"))).alias("start_dist"), F.max(F.when(F.col("side") == "end", F.col("dist"))).alias("end_dist"))
    return laps.join(sorted_join(d), ["session_id", "lap_num"])


def slice_distance(samples: DataFrame, laps: DataFrame, dist_map: DataFrame, lo: float, hi: float, offset: float = 0.0, grid_ms: float = 10.0) -> DataFrame:
    """P2 by distance: samples of each lap (laps with start_dist) in [lo, hi) metres after its start plus ``offset``; adds ``dist`` and ``rel``."""
    own = assign_laps(samples, laps).join(laps.select("session_id", "lap_num", "start_dist"), ["session_id", "lap_num"])
    own = time_to_dist(own, dist_map, grid_ms).withColumn("rel", F.col("dist") - F.col("start_dist") - F.lit(offset))
    return own.filter((F.col("rel") >= lo) & (F.col("rel") < hi)).drop("start_dist")


def time_slip(laps: DataFrame, reference: DataFrame, dist_map: DataFrame, step_m: float, grid_ms: float = 10.0) -> DataFrame:
    """Seconds lost to the session's reference lap at equal distance from the lap's start.

    ``laps`` and ``reference`` have start_tc, end_tc, start_dist, end_dist; every lap is compared
    each ``step_m`` metres of the reference's length. The reference itself gives NULL.
    """
    ref = reference.select("session_id", F.col("lap_num").alias("ref_num"), F.col("start_tc").alias("ref_tc"), F.col("start_dist").alias("ref_dist"), micrometres(F.col("end_dist") - F.col("start_dist")).alias("ref_len"))
    x = laps.join(ref, "session_id").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("ref_len") / step_m).cast("long"))))
    x = x.withColumn("rel", F.col("i") * F.lit(float(step_m))).withColumn("side", F.explode(F.array(F.lit("own"), F.lit("ref"))))
    x = x.select("session_id", "lap_num", "ref_num", "rel", "side", F.when(F.col("side") == "own", F.col("start_tc")).otherwise(F.col("ref_tc")).alias("t0"), (F.col("rel") + F.when(F.col("side") == "own", F.col("start_dist")).otherwise(F.col("ref_dist"))).alias("dist"))
    t = dist_to_time(x, dist_map, grid_ms, "tc").withColumn("lap_time", F.col("tc") - F.col("t0"))
    both = t.groupBy("session_id", "lap_num", "ref_num", "rel").agg(F.max(F.when(F.col("side") == "own", F.col("lap_time"))).alias("own"), F.max(F.when(F.col("side") == "ref", F.col("lap_time"))).alias("ref"))
    return both.select("session_id", "lap_num", "rel", F.when(F.col("lap_num") != F.col("ref_num"), (F.col("own") - F.col("ref")) / 1000).alias("slip_s"))


def resample_by_distance(samples: DataFrame, laps: DataFrame, dist_map: DataFrame, step_m: float, grid_ms: float = 10.0) -> DataFrame:
    """Every channel at even distances from each lap's start (laps with start_dist, end_dist).

    Point i stands i * ``step_m`` metres into the lap; values are interpolated at its time.
    """
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(micrometres(F.col("end_dist") - F.col("start_dist")) / step_m).cast("long")))
    at = laps.withColumn("i", i).withColumn("dist", F.col("start_dist") + F.col("i") * F.lit(float(step_m)))
    # Written, since each ordered join looks at its points twice: once for the edges of buckets.
    at = kept(dist_to_time(at.select("session_id", "lap_num", "i", "dist"), dist_map, grid_ms), "places")
    channels = samples.select("session_id", "channel").distinct()
    return interp_join(at.join(channels, "session_id"), samples).select("session_id", "lap_num", "channel", "i", "value")


#: Places that one task gets.
PLACES_A_TASK = 1_000_000


def resample_lap(samples: DataFrame, laps: DataFrame, dist_map: DataFrame, channels: list[str], step_m: float, grid_ms: float = 10.0) -> DataFrame:
    """W7 for one lap of each session (laps with start_tc, end_tc, start_dist, end_dist), wide: session_id, i and a column for each of ``channels``.

    Places are many times the samples that they lie between, so they are made last, of pieces of time that no sample
    and no stretch of the map divides: only pieces are shuffled and written. Of samples outside a lap its neighbours count,
    of the map the stretches that hold distances of the lap. Rows are dealt by session_id.
    """
    g = F.lit(float(grid_ms))
    last = F.floor(micrometres(F.col("end_dist") - F.col("start_dist")) / step_m).cast("long")
    own = laps.select("session_id", "start_dist", "end_dist", last.alias("last_i"))
    total = own.agg(F.sum(F.col("last_i") + 1)).first()[0] or 0
    tasks = max(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PLACES_A_TASK))
    # By the next step a stretch's end is known but for the order of sums, which a millimetre covers.
    at, to = micrometres(F.col("before") + F.col("f") * F.col("v")), _sum_to(F.col("k1") - 1) + F.col("next_step")
    held = dist_map.join(own, "session_id").withColumn("at", at).filter((F.col("at") <= F.col("end_dist") + 1e-3) & F.coalesce(to >= F.col("start_dist") - 1e-3, F.lit(True)))
    held = kept(held.select("session_id", *_CARRY, "at", "start_dist", "last_i"), "lap_stretches")
    # As in dist_to_time: of stretches that begin at or before a distance, the last.
    stretches = held.withColumn("next_at", F.lead("at").over(Window.partitionBy("session_id").orderBy("at", "k0")))
    stretches = stretches.select("session_id", (F.col("k0") * g).alias("t"), F.struct(*_CARRY, "at", "next_at", "start_dist", "last_i").alias("st"))
    span = held.groupBy("session_id").agg((F.min("k0") * g).alias("lo"), (F.max("k1") * g).alias("hi"))
    names = {c: f"_c{i}" for i, c in enumerate(channels)}
    tc = F.col("tc").cast("double")
    side = F.when(tc < F.col("lo"), -1).when(tc > F.col("hi"), 1).otherwise(0)
    # What lies ahead of the lap, and behind it, is one row each: the sample nearest to it.
    t = F.when(side < 0, -math.inf).when(side > 0, math.inf).otherwise(tc)
    own_sample = F.struct(F.when(side > 0, -tc).otherwise(tc).alias("near"), F.col("value").alias("v"), tc.alias("_on"))
    rows = samples.filter(F.col("channel").isin(*channels)).join(span, "session_id").withColumn("t", t)
    rows = rows.groupBy("session_id", "t").agg(*[F.max(F.when(F.col("channel") == c, own_sample)).alias(s) for c, s in names.items()])
    rows = rows.select("session_id", "t", *[F.when(F.col(s).isNotNull(), F.struct(F.col(f"{s}._on").alias("_on"), F.col(f"{s}.v").alias("v"))).alias(s) for s in names.values()])
    rows = rows.unionByName(stretches, allowMissingColumns=True).groupBy("session_id", "t").agg(*[F.max(c).alias(c) for c in ("st", *names.values())])
    w = Window.partitionBy("session_id").orderBy("t")
    starts = F.col("st").isNotNull()
    pieces = rows.select(
        "session_id", "t", F.lead("t").over(w).alias("t1"), starts.alias("first"), F.coalesce(F.lead(starts).over(w), F.lit(True)).alias("last"), F.max("st").over(running(w)).alias("st"),
        *[F.max(s).over(running(w)).alias(f"{s}_prev") for s in names.values()], *[ignoring_nulls(s, ["session_id"], ["t"]).alias(f"{s}_next") for s in names.values()],
    )
    pieces = pieces.filter(F.col("st").isNotNull() & (F.col("t") < math.inf)).withColumn("last", F.col("last") | (F.col("t1") == math.inf))
    ends = [F.col(f"{s}_{side}.{c}").alias(f"{s}_{side}_{c}") for s in names.values() for side in ("prev", "next") for c in ("_on", "v")]
    pieces = kept(pieces.select("session_id", "t", "t1", "first", "last", "st.*", *ends), "pieces").repartition(tasks, "session_id")

    def reached(at: Column) -> Column:
        k = F.least(F.floor(at / g), F.col("k1") - 1).cast("double")
        return (_sum_to(k) + (at / g - k) * _step_at(k + 1) - F.col("start_dist")) / step_m

    # Numbers that may lie on the piece; the next filters decide.
    low = F.greatest(F.floor(F.when(F.col("first"), (F.col("at") - F.col("start_dist")) / step_m).otherwise(reached(F.col("t")))).cast("long") - 1, F.lit(0))
    until = F.when(~F.col("last"), reached(F.col("t1"))).otherwise((F.col("next_at") - F.col("start_dist")) / step_m)
    high = F.least(F.coalesce(F.ceil(until).cast("long") + 1, F.col("last_i")), F.col("last_i"))
    x = pieces.withColumn("_low", low).withColumn("_high", high).filter("_low <= _high").withColumn("i", F.explode(F.sequence("_low", "_high")))
    x = x.withColumn("dist", F.col("start_dist") + F.col("i") * F.lit(float(step_m)))
    x = x.filter(~beyond(F.col("at"), F.col("dist")) & (F.col("next_at").isNull() | beyond(F.col("next_at"), F.col("dist"))))
    at_piece = ["session_id", "i", "t", "t1", "first", "last", *[f"{s}_{side}_{c}" for s in names.values() for side in ("prev", "next") for c in ("_on", "v")]]
    x = _times(x, at_piece, grid_ms, "tc").filter((F.col("first") | (F.col("tc") >= F.col("t"))) & (F.col("last") | (F.col("tc") < F.col("t1"))))
    return x.select("session_id", "i", *[linear(F.col("tc"), f"{s}_prev_", f"{s}_next_", "_on", "v").alias(c) for c, s in names.items()])
