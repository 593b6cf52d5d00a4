"""Ordered joins: as-of, holding and interpolating lookups, alignment, laps of samples.

An inequality join would pair every point with every sample of its key. Here both sides are
united, dealt by key and bucket of time once, sorted once, and each point takes the last sample
before it (and the first after it) with window functions: n log n, no row is multiplied, and no task
holds a whole session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import BUCKET_MS, bucket, edges, ignoring_nulls, running, within

KEYS = ("session_id", "channel")


def _united(points: DataFrame, samples: DataFrame, keys: tuple[str, ...], on: str, carry: list[str], width: float) -> DataFrame:
    """Samples (is_point 0, with struct s), points (is_point 1, with struct p) and the edges of their buckets."""
    at = F.col(on).cast("double").alias("_on")
    side = F.lit(0).alias("_side")
    left = samples.select(*keys, at, side, F.lit(0).alias("_is_point"), F.struct(at, *carry).alias("_s"))
    right = points.select(*keys, at, side, F.lit(1).alias("_is_point"), F.struct(*points.columns).alias("_p"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_bucket", bucket(F.col("_on"), width))
    return both.unionByName(edges(both.select(*keys, "_bucket", "_s"), keys, ["_s"]), allowMissingColumns=True)


def asof(points: DataFrame, samples: DataFrame, keys: tuple[str, ...] = KEYS, on: str = "tc", carry: tuple[str, ...] = ("value",), strict: bool = False, prefix: str = "prev_", width: float = BUCKET_MS) -> DataFrame:
    """J: ``points`` with the columns ``carry`` (and ``on``) of the last sample at or before each; NULL if none.

    ``strict`` takes only samples before the point. Of samples at one place the last by ``carry`` counts.
    ``width`` is that of a bucket of ``on``.
    """
    both = _united(points, samples, keys, on, list(carry), width)
    ahead = running(within(keys, "_on", (1 - F.col("_is_point")) if strict else F.col("_is_point")))
    both = both.withColumn("_prev", F.max("_s").over(ahead)).filter("_is_point = 1")
    return both.select("_p.*", F.col("_prev._on").alias(f"{prefix}{on}"), *[F.col(f"_prev.{c}").alias(f"{prefix}{c}") for c in carry])


def neighbours(points: DataFrame, samples: DataFrame, keys: tuple[str, ...] = KEYS, on: str = "tc", value: str = "value", width: float = BUCKET_MS) -> DataFrame:
    """``points`` with the samples around each: prev_on, prev_value (at or before), next_on, next_value (at or after).

    Of samples at one place the largest value counts.
    """
    both = _united(points, samples.withColumnRenamed(value, "_v"), keys, on, ["_v"], width)
    order = ["_on", "_is_point", "_s DESC"]
    ahead = running(within(keys, "_on", "_is_point", F.desc("_s")))
    both = both.withColumn("_prev", F.max("_s").over(ahead)).withColumn("_after", ignoring_nulls("_s", [*keys, "_bucket"], ["_side", *order])).filter("_is_point = 1")
    after = F.when(F.col("_prev._on") == F.col("_on"), F.col("_prev")).otherwise(F.col("_after"))
    both = both.withColumn("_next", after)
    return both.select("_p.*", *[F.col(f"_{side}.{c}").alias(f"{side}_{n}") for side in ("prev", "next") for c, n in (("_on", "on"), ("_v", "value"))])


def linear(at: Column, prev: str = "prev_", following: str = "next_", on: str = "on", value: str = "value") -> Column:
    """The value at ``at`` on the line between the neighbours; at and beyond the ends, the end's value."""
    t0, v0, t1, v1 = F.col(prev + on), F.col(prev + value), F.col(following + on), F.col(following + value)
    span = t1 - t0
    inside = v0 + (v1 - v0) * F.try_divide(at - t0, span)
    return F.when(t0.isNull(), v1).when(t1.isNull() | (span == 0), v0).otherwise(inside)


def interp_join(points: DataFrame, samples: DataFrame, keys: tuple[str, ...] = KEYS, on: str = "tc", value: str = "value", name: str = "value", width: float = BUCKET_MS) -> DataFrame:
    """Value at each point's place by linear interpolation, clamped at both ends."""
    found = neighbours(points, samples, keys, on, value, width)
    return found.select(*points.columns, linear(F.col(on)).alias(name))


def hold_join(points: DataFrame, samples: DataFrame, keys: tuple[str, ...] = KEYS, on: str = "tc", value: str = "value", name: str = "value", width: float = BUCKET_MS) -> DataFrame:
    """Value of the last sample at or before each point; before the first sample, the first value."""
    found = neighbours(points, samples, keys, on, value, width)
    return found.select(*points.columns, F.coalesce("prev_value", "next_value").alias(name))


def timecode_union(samples: DataFrame) -> DataFrame:
    """The distinct timecodes of a session's channels."""
    return samples.select("session_id", "tc").distinct()


def grid(samples: DataFrame, rate: float) -> DataFrame:
    """A fixed grid of timecodes from 0 to each session's last, ``rate`` a second."""
    step = 1000.0 / rate
    ends = samples.groupBy("session_id").agg(F.max("tc").alias("end"))
    return ends.select("session_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("end") / step).cast("long"))).alias("i")).select("session_id", (F.col("i") * F.lit(step)).alias("tc"))


def align(samples: DataFrame, channels: dict[str, bool], rate: float | None = None, width: float = BUCKET_MS) -> DataFrame:
    """One row per session and timecode with a column per channel; True interpolates, False holds.

    Timecodes are all those of the named channels, or a grid of ``rate`` a second. Of samples at one
    timecode the largest value counts. One shuffle, by session and bucket of time.
    """
    own = samples.filter(F.col("channel").isin(*channels))
    names = {c: f"_s{i}" for i, c in enumerate(channels)}
    at = F.col("tc").cast("double")
    sample = [F.when((F.col("channel") == c) & F.col("value").isNotNull(), F.struct(at.alias("_on"), F.col("value").alias("v"))).alias(s) for c, s in names.items()]
    rows = own.select("session_id", at.alias("tc"), F.lit(0).alias("_side"), F.lit(None if rate else 1).cast("int").alias("_at"), *sample)
    if rate:
        rows = rows.unionByName(grid(own, rate).select("session_id", "tc", F.lit(0).alias("_side"), F.lit(1).alias("_at")), allowMissingColumns=True)
    rows = rows.withColumn("_bucket", bucket(F.col("tc"), width))
    found = edges(rows, ("session_id",), list(names.values()))
    rows = rows.unionByName(found, allowMissingColumns=True).repartition("session_id", "_bucket")
    wide = rows.groupBy("session_id", "_bucket", "_side", "tc").agg(F.max("_at").alias("_at"), *[F.max(s).alias(s) for s in names.values()])
    order = within(("session_id",), "tc")
    wide = wide.select(
        "session_id", "tc", "_at",
        *[F.max(s).over(running(order)).alias(f"_p{s}") for s in names.values()],
        *[ignoring_nulls(s, ["session_id", "_bucket"], ["_side", "tc"]).alias(f"_n{s}") for s in names.values()],
    )
    out = []
    for c, linearly in channels.items():
        p, n = F.col(f"_p{names[c]}"), F.col(f"_n{names[c]}")
        held = F.coalesce(p["v"], n["v"])
        if linearly:
            inside = p["v"] + (n["v"] - p["v"]) * F.try_divide(F.col("tc") - p["_on"], n["_on"] - p["_on"])
            held = F.when(p.isNull() | n.isNull() | (p["_on"] == F.col("tc")), held).otherwise(inside)
        out.append(held.alias(c))
    return wide.filter("_at = 1").select("session_id", "tc", *out)


#: Width of a tile of time in which laps and samples meet: about a lap.
LAP_TILE_MS = 120_000.0


def assign_laps(samples: DataFrame, laps: DataFrame, inclusive: bool = False, width: float = LAP_TILE_MS) -> DataFrame:
    """Samples with lap_num, start_tc and end_tc of each lap that holds them, half-open; rows outside laps go.

    ``inclusive`` (P1) also gives a sample on a lap's end to that lap. Samples keep all columns.
    Every lap stands in the tiles of time that it covers, and meets only samples of these: a sample is
    compared with the laps of its tile however many its session has, and a long session is spread
    over tasks. The planner broadcasts the tiles while they are small.
    """
    lap = laps.filter("end_tc > start_tc").select("session_id", "lap_num", "start_tc", "end_tc")
    lap = lap.withColumn("_tile", F.explode(F.sequence(bucket(F.col("start_tc"), width), bucket(F.col("end_tc"), width))))
    before_end = F.col("tc") <= F.col("end_tc") if inclusive else F.col("tc") < F.col("end_tc")
    found = samples.withColumn("_tile", bucket(F.col("tc"), width)).join(lap, ["session_id", "_tile"])
    return found.filter((F.col("tc") >= F.col("start_tc")) & before_end).select(*samples.columns, "lap_num", "start_tc", "end_tc")


def slice_lap(samples: DataFrame, laps: DataFrame) -> DataFrame:
    """Samples with start <= tc <= end; one on a boundary is in both laps."""
    return assign_laps(samples, laps, inclusive=True)


def slice_window(samples: DataFrame, laps: DataFrame, lo: float, hi: float, offset: float = 0.0) -> DataFrame:
    """Samples of each lap in the half-open window [lo, hi) after its start plus ``offset``; adds ``rel``."""
    own = assign_laps(samples, laps).withColumn("rel", F.col("tc") - F.col("start_tc") - F.lit(offset))
    return own.filter((F.col("rel") >= lo) & (F.col("rel") < hi))
