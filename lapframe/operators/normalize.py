"""Normalisation of raw records: clocks, batches, calibration, coded values, sentinels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import ecef_to_lla_steps
from .align import asof, interp_join
from .buckets import BUCKET_MS, bucket, edges, within


def unwrap_counter(df: DataFrame, column: str, modulus: float, order: str, keys: tuple[str, ...] = ("session_id",), name: str = "tc", width: float = BUCKET_MS) -> DataFrame:
    """Monotone time from a counter that wraps at ``modulus``: steps modulo it, summed.

    Steps are summed within buckets of ``order`` (a number; ``width`` is a bucket's), and the buckets'
    totals, with the step from one to the next, over the key.
    """
    w = Window.partitionBy(*keys, "_bucket").orderBy(order)
    rows = df.withColumn("_bucket", bucket(F.col(order), width))
    step = F.pmod(F.col(column) - F.lag(column).over(w), F.lit(modulus))
    rows = rows.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("_run", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    totals = rows.groupBy(*keys, "_bucket").agg(F.min_by(column, order).alias("_first"), F.max_by(column, order).alias("_last"), F.sum("_step").alias("_total"))
    by = Window.partitionBy(*keys).orderBy("_bucket")
    jump = F.pmod(F.col("_first") - F.coalesce(F.lag("_last").over(by), F.lit(0)), F.lit(modulus))
    base = F.sum("_jump").over(by.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("_total").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    bases = totals.withColumn("_jump", jump).select(*keys, "_bucket", base.alias("_base"))
    return rows.join(bases, [*keys, "_bucket"]).select(*[c for c in df.columns if c != name], (F.col("_base") + F.col("_run")).alias(name))


def drop_replayed(df: DataFrame, order: str = "seq", keys: tuple[str, ...] = ("session_id", "channel"), width: float = BUCKET_MS) -> DataFrame:
    """Records whose tc exceeds every earlier one's of their channel, by a record sequence (a number; ``width`` is a bucket's)."""
    rows = df.withColumn("_at", F.col(order)).withColumn("_t", F.struct(F.col("tc").alias("_on"))).withColumn("_bucket", bucket(F.col(order), width)).withColumn("_side", F.lit(0))
    rows = rows.unionByName(edges(rows, keys, ["_t"]).filter("_side < 0"), allowMissingColumns=True)
    top = F.max("_t").over(within(keys, "_at").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_top", top).filter("_side = 0 AND (_top IS NULL OR tc > _top._on)").select(*df.columns)


def explode_batches(df: DataFrame, step_ms: float | str) -> DataFrame:
    """Arrays ``values`` to rows at tc + i * step; the step is a number or a column."""
    step = F.col(step_ms) if isinstance(step_ms, str) else F.lit(float(step_ms))
    rest = [c for c in df.columns if c not in ("values", "tc", step_ms)]
    x = df.select(*rest, "tc", step.alias("_step"), F.posexplode("values").alias("_i", "value"))
    return x.select(*rest, (F.col("tc") + F.col("_i") * F.col("_step")).alias("tc"), "value")


def asof_clock(messages: DataFrame, clock: DataFrame) -> DataFrame:
    """The time of a message (session_id, seq) is that of the clock message strictly before it; else the first."""
    first = clock.groupBy("session_id").agg(F.min_by("tc", "seq").alias("first_tc"))
    found = asof(messages, clock, ("session_id",), "seq", ("tc",), strict=True, prefix="clock_")
    return found.join(first, "session_id", "left").select(*messages.columns, F.coalesce("clock_tc", "first_tc").alias("tc"))


def map_clock(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per session, events on the GPS clock (their mean is nearer the GPS mean) move to the logger's.

    ``pairs`` has session_id, gps_tc, tc; conversion is linear interpolation, clamped.
    """
    ev = events.groupBy("session_id").agg(F.avg("tc").alias("_ev"))
    mid = pairs.groupBy("session_id").agg(F.avg("gps_tc").alias("_gps"), F.avg("tc").alias("_own"))
    gps = ev.join(mid, "session_id").select("session_id", (F.abs(F.col("_ev") - F.col("_gps")) < F.abs(F.col("_ev") - F.col("_own"))).alias("on_gps"))
    mapped = interp_join(events, pairs.select("session_id", F.col("gps_tc").alias("tc"), F.col("tc").alias("value")), ("session_id",), name="_mapped")
    x = mapped.join(gps, "session_id", "left")
    return x.select(*[c for c in events.columns if c != "tc"], F.when(F.col("on_gps"), F.col("_mapped")).otherwise(F.col("tc")).alias("tc"))


def split_subchannels(records: DataFrame, names: DataFrame) -> DataFrame:
    """A stream of (session_id, tc, id, value) to channels; ``names`` (id, name), others by number."""
    return records.join(F.broadcast(names), "id", "left").select("session_id", F.coalesce("name", F.concat(F.lit("id "), F.col("id").cast("string"))).alias("channel"), "tc", "value")


def explode_array_channel(samples: DataFrame, template: str | None = None) -> DataFrame:
    """Array cells ``values`` to channels ``name[1]``…, or by a template in which ``$`` is the number."""
    x = samples.select("session_id", "channel", "tc", F.posexplode("values").alias("_i", "value"))
    n = (F.col("_i") + 1).cast("string")
    name = F.replace(F.lit(template), F.lit("$"), n) if template else F.concat("channel", F.lit("["), n, F.lit("]"))
    return x.select("session_id", name.alias("channel"), "tc", "value")


def calibration(form: Column, p: Column, q: Column, r: Column, s: Column) -> tuple[Column, Column]:
    """(a, b) of a*v + b for the three forms: v*mul/(scale*10^dec)+off; (v+transform)*scale; v/scale+adder."""
    a = F.when(form == "motec", F.try_divide(p, q * F.pow(F.lit(10.0), r))).when(form == "linear", q).otherwise(F.try_divide(F.lit(1.0), q))
    b = F.when(form == "motec", s).when(form == "linear", p * q).otherwise(p)
    return a, b


def apply_calibration(samples: DataFrame, defs: DataFrame) -> DataFrame:
    """Raw to engineering values; ``defs`` (channel, form, p, q, r, s); channels without one stay."""
    a, b = calibration(F.col("form"), F.col("p"), F.col("q"), F.col("r"), F.col("s"))
    ab = defs.select("channel", a.alias("_a"), b.alias("_b"))
    x = samples.join(F.broadcast(ab), "channel", "left")
    value = F.when(F.col("_a").isNull(), F.col("value")).otherwise(F.col("_a") * F.col("value") + F.col("_b"))
    return x.select(*[c for c in samples.columns if c != "value"], value.alias("value"))


def fix_units(samples: DataFrame, rules: list[tuple[str, float]]) -> DataFrame:
    """Values of the units named, times a factor: ratio logged as % is (\"%\", 100), mV as V (\"V\", 0.001)."""
    factor = F.lit(1.0)
    for unit, by in rules:
        factor = F.when(F.col("units") == unit, F.lit(by)).otherwise(factor)
    return samples.withColumn("value", F.col("value") * factor)


def decode_enum(samples: DataFrame, mapping: dict[int, float]) -> DataFrame:
    """Coded values by a small table; others NULL."""
    table = F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (int(k), float(v))])
    return samples.withColumn("value", F.try_element_at(table, F.col("value").cast("int")))


def decode_gear_bits(samples: DataFrame) -> DataFrame:
    """Gear from bits 16 to 18 of a word; 0 where bit 19 is set."""
    v = F.col("value").cast("long")
    return samples.withColumn("value", F.when(v.bitwiseAND(0x80000) != 0, 0.0).otherwise(F.shiftright(v, 16).bitwiseAND(7).cast("double")))


def drop_gps_sentinels(samples: DataFrame, lat: str, lon: str, alt: str, rule: str = "zero") -> DataFrame:
    """Rows of the position channels where the fix is (0, 0), or (90, 0) for rule ``pole``, go together."""
    want = (0.0, 0.0) if rule == "zero" else (90.0, 0.0)
    # A window over the few rows of one time, not a join: what is dropped may be a large table.
    at = Window.partitionBy("session_id", "tc")
    seen = [F.coalesce(F.bool_or((F.col("channel") == c) & (F.col("value") == v)).over(at), F.lit(False)) for c, v in zip((lat, lon), want, strict=True)]
    own = F.coalesce(F.col("channel").isin(lat, lon, alt), F.lit(False)) & F.col("session_id").isNotNull() & F.col("tc").isNotNull()
    x = samples.withColumns({"_lat": seen[0], "_lon": seen[1], "_own": own})
    return x.filter("NOT (_own AND _lat AND _lon)").select(*samples.columns)


def infer_decimals(cells: DataFrame) -> DataFrame:
    """Decimals of each channel's first non-empty text value among its first 1000 lines (channel, line, cell)."""
    x = cells.filter((F.col("line") < 1000) & (F.col("cell") != ""))
    return x.groupBy("channel").agg(F.min_by(F.length(F.regexp_extract("cell", r"\.(.*)$", 1)), "line").alias("dec_pts"))


def ecef_to_lla(samples: DataFrame, prefix: str = "ecef_") -> DataFrame:
    """Six ECEF channels (x y z in cm, dx dy dz in cm/s) to lat, lon, alt and speed channels."""
    names = [prefix + n for n in ("x", "y", "z", "dx", "dy", "dz")]
    # One aggregate, not a pivot, which first groups by channel as well: that shuffles six times the rows once more.
    wide = samples.filter(F.col("channel").isin(*names)).groupBy("session_id", "tc").agg(*[F.max(F.when(F.col("channel") == n, F.col("value"))).alias(n) for n in names])
    wide = wide.select("session_id", "tc", *[(F.col(f"`{n}`") / 100).alias(s) for n, s in zip(names, ("x", "y", "z", "dx", "dy", "dz"), strict=True)])
    for step in ecef_to_lla_steps("x", "y", "z"):
        wide = wide.withColumns(step)
    wide = wide.withColumn("speed", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")))
    return wide.unpivot(["session_id", "tc"], ["lat", "lon", "alt", "speed"], "channel", "value").filter("value IS NOT NULL")


def rebase_time(samples: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Tc less the session's smallest, or than ``starts`` (session_id, start_tc)."""
    base = starts if starts is not None else samples.groupBy("session_id").agg(F.min("tc").alias("start_tc"))
    return samples.join(base, "session_id").withColumn("tc", F.col("tc") - F.col("start_tc")).drop("start_tc")


def repair_timecode(gps: DataFrame, stream: DataFrame) -> DataFrame:
    """Of a GPS record (session_id, seq, raw) only the low 14 bits hold; the rest is taken from the stream's time (session_id, seq, tc) then, nearest."""
    now = asof_clock(gps, stream)
    raw, tc = F.col("raw").cast("long"), F.floor("tc").cast("long")
    diff = F.pmod(raw - tc, F.lit(16384))
    near = F.when(diff >= 8192, diff - 16384).otherwise(diff)
    return now.select(*gps.columns, (tc + near).cast("double").alias("tc"))
