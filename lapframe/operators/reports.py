"""Reports: channel statistics, histograms, value tables, sectors, downsampling, pairs, cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .align import assign_laps, hold_join, interp_join
from .distance import dist_to_time


def _by_series() -> WindowSpec:
    return Window.partitionBy("session_id", "channel")


def channel_stats(samples: DataFrame) -> DataFrame:
    """A1: min, max and count of every channel."""
    return samples.groupBy("session_id", "channel").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count("value").alias("n"))


def finite_only(df: DataFrame, column: str = "value") -> DataFrame:
    """P5: rows whose value is a finite number."""
    c = F.col(column)
    return df.filter(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def finite_channels(df: DataFrame) -> DataFrame:
    """P5, strict: only channels all of whose values are finite."""
    c = F.col("value")
    bad = df.filter(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).select("session_id", "channel").distinct()
    return df.join(bad, ["session_id", "channel"], "left_anti")


def weighted_histogram(samples: DataFrame, laps: DataFrame | None = None, bins: int = 30) -> DataFrame:
    """A3: percent of time per value bin and channel, with the running total.

    A sample weighs the time to the channel's next sample; a channel's last one has no weight and
    takes no part. Edges run from the least to the largest value over all channels and laps chosen;
    the last bin is closed.
    """
    w = finite_only(samples).withColumn("weight", F.lead("tc").over(_by_series().orderBy("tc")) - F.col("tc")).filter("weight IS NOT NULL")
    if laps is not None:
        w = assign_laps(w, laps)
    edges = w.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    x = w.join(F.broadcast(edges))  # one row
    b = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide((F.col("value") - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0)))).cast("int")
    per = x.groupBy("channel", b.alias("bin")).agg(F.sum("weight").alias("weight"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    total = Window.partitionBy("channel")
    pct = 100 * F.try_divide("weight", F.sum("weight").over(total))
    per = per.withColumn("percent", pct).withColumn("cumulative", F.sum("percent").over(total.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    return per.select("channel", "bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("edge"), "percent", "cumulative")


def table2d(rows: DataFrame, x: str | None, y: str | None, value: str, x_spacing: float = 1.0, y_spacing: float = 1.0, closeness: float = 50.0, keep: str | None = None) -> DataFrame:
    """A4: mean and count of ``value`` over a grid of two axes.

    A cell is the axis value over its spacing, rounded half to even, times the spacing; a row
    counts if it is closer to the cell than ``closeness`` percent of the spacing on each axis. A
    missing axis is 0. ``keep`` names a column that must not be 0.
    """
    for name, axis, spacing in (("x_cell", x, x_spacing), ("y_cell", y, y_spacing)):
        cell = F.rint(F.col(axis) / spacing) * spacing if axis else F.lit(0.0)
        rows = rows.withColumn(name, cell)
        if axis:
            rows = rows.filter(F.abs(F.col(axis) - F.col(name)) / spacing < closeness / 100)
    if keep:
        rows = rows.filter(F.col(keep) != 0)
    return rows.groupBy("x_cell", "y_cell").agg(F.avg(value).alias("mean_value"), F.count(value).alias("n"))


def value_table(samples: DataFrame, value: str, x: str, y: str, x_spacing: float, y_spacing: float, closeness: float = 50.0) -> DataFrame:
    """A4 over channels: the axes are interpolated at the value channel's timecodes."""
    own = samples.filter(F.col("channel") == value).select("session_id", "tc", F.col("value").alias("v"))
    for name, channel in (("ax", x), ("ay", y)):
        axis = samples.filter(F.col("channel") == channel).select("session_id", "tc", "value")
        own = interp_join(own, axis, ("session_id",), name=name)
    return table2d(own.filter("ax IS NOT NULL AND ay IS NOT NULL"), "ax", "ay", "v", x_spacing, y_spacing, closeness)


def matrix(cells: DataFrame) -> DataFrame:
    """A4's cells as a matrix: a row per y, a column per x (U3 gives the axes)."""
    return cells.groupBy("y_cell").pivot("x_cell").agg(F.first("mean_value"))


def axis_values(cells: DataFrame) -> DataFrame:
    """The distinct cells of each axis."""
    return cells.select(F.lit("x").alias("axis"), F.col("x_cell").alias("cell")).union(cells.select(F.lit("y"), F.col("y_cell"))).distinct()


def sector_times(laps: DataFrame, markers: DataFrame, dist_map: DataFrame, length: DataFrame, grid_ms: float = 10.0) -> DataFrame:
    """Per lap and marker (seq, name, dist from the lap's start) the time since the last valid marker.

    Laps under half the track's ``length`` (session_id, length) and times that don't increase give NULL.
    Adds the best of each sector, the gap to it, and a band of the gap.
    """
    m = markers.select("session_id", "seq", "name", F.coalesce("dist", F.lit(0.0)).alias("marker_dist"))
    x = laps.join(m, "session_id").join(length, "session_id").withColumn("dist", F.col("start_dist") + F.col("marker_dist"))
    x = x.filter((F.col("end_dist") - F.col("start_dist")) >= 0.5 * F.col("length")).filter(F.col("dist") <= F.col("end_dist"))
    t = dist_to_time(x.select("session_id", "lap_num", "start_tc", "seq", "name", "dist"), dist_map, grid_ms, "tc")
    ahead = Window.partitionBy("session_id", "lap_num").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("before", F.coalesce(F.max("tc").over(ahead), F.col("start_tc"))).withColumn("sector", F.when(F.col("tc") > F.col("before"), F.col("tc") - F.col("before")))
    full = laps.select("session_id", "lap_num").join(m.select("session_id", "seq", "name"), "session_id").join(t.select("session_id", "lap_num", "seq", "sector"), ["session_id", "lap_num", "seq"], "left")
    best = F.min("sector").over(Window.partitionBy("session_id", "seq"))
    full = full.withColumn("best", best).withColumn("delta", F.col("sector") - F.col("best"))
    band = F.when(F.col("delta").isNull(), None).when(F.abs("delta") <= 1, "best").when(F.col("delta") < 100, "<0.1").when(F.col("delta") < 300, "<0.3").when(F.col("delta") < 500, "<0.5").otherwise("slower")
    return full.select("session_id", "lap_num", "seq", "name", "sector", "best", "delta", band.alias("band"))


def best_total(sectors: DataFrame) -> DataFrame:
    """The sum of each session's best sectors."""
    return sectors.groupBy("session_id", "seq").agg(F.min("sector").alias("b")).groupBy("session_id").agg(F.sum("b").alias("best_total"))


def downsample_minmax(samples: DataFrame, scale: float, lo: float = 0.0, hold: bool = False) -> DataFrame:
    """Per bucket rint((tc-lo)*scale): min, max, first and last value.

    For held channels the value from the bucket before reaches into the bucket.
    """
    x = samples.filter(F.col("tc") >= lo).withColumn("bucket", F.rint((F.col("tc") - F.lit(lo)) * scale).cast("long"))
    b = x.groupBy("session_id", "channel", "bucket").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.min_by("value", "tc").alias("first_value"), F.max_by("value", "tc").alias("last_value"))
    if hold:
        before = F.lag("last_value").over(_by_series().orderBy("bucket"))
        b = b.withColumn("_b", before).withColumn("min_value", F.least("min_value", "_b")).withColumn("max_value", F.greatest("max_value", "_b")).drop("_b")
    return b


def scatter_pairs(samples: DataFrame, laps: DataFrame, x: str, y: str, points: int = 10_000) -> DataFrame:
    """(x, y) per lap, y interpolated linearly at x's timecodes; every k-th row, k = max(1, n // points)."""
    own = assign_laps(samples.filter(F.col("channel") == x).select("session_id", "tc", F.col("value").alias("x")), laps, inclusive=True)
    y_rows = samples.filter(F.col("channel") == y).select("session_id", "tc", "value")
    both = interp_join(own.select("session_id", "lap_num", "tc", "x"), y_rows, ("session_id",), name="y").filter("y IS NOT NULL")
    lap = Window.partitionBy("session_id", "lap_num")
    both = both.withColumn("i", F.row_number().over(lap.orderBy("tc")) - 1).withColumn("k", F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(lap) / points)))
    return both.filter("pmod(i, k) = 0").select("session_id", "lap_num", "tc", "x", "y")


def axis_ranges(samples: DataFrame, laps: DataFrame) -> DataFrame:
    """Each channel's common range over all laps, padded by 3 %; a flat one by 1 each way."""
    r = assign_laps(samples, laps).groupBy("channel").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    pad = F.when(F.col("a") == F.col("b"), 1.0).otherwise((F.col("b") - F.col("a")) * 0.03)
    return r.select("channel", (F.col("a") - pad).alias("lo"), (F.col("b") + pad).alias("hi"))


def values_at_cursor(samples: DataFrame, laps: DataFrame, channels: dict[str, bool], position: float, dist_map: DataFrame | None = None, baseline: int | None = None, grid_ms: float = 10.0) -> DataFrame:
    """Every channel at one time after each lap's start; True interpolates, False holds.

    With a ``dist_map`` the position is a distance (laps with start_dist, end_dist). ``delta`` is the gap to lap number
    ``baseline``, or else to the session's first lap.
    """
    if dist_map is None:
        at = laps.select("session_id", "lap_num", (F.col("start_tc") + position).alias("tc"), "end_tc").filter("tc < end_tc").drop("end_tc")
    else:
        at = laps.withColumn("dist", F.col("start_dist") + position).filter("dist < end_dist").select("session_id", "lap_num", "dist")
        at = dist_to_time(at, dist_map, grid_ms).drop("dist")
    at = at.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    lines = [c for c, linear in channels.items() if linear]
    own = samples.filter(F.col("channel").isin(*channels))
    a = interp_join(at.filter(F.col("channel").isin(*lines)), own)
    b = hold_join(at.filter(~F.col("channel").isin(*lines)), own)
    both = a.unionByName(b)
    if baseline is None:
        base = F.first("value").over(_by_series().orderBy("lap_num").rowsBetween(Window.unboundedPreceding, 0))
    else:
        base = F.max(F.when(F.col("lap_num") == baseline, F.col("value"))).over(_by_series())
    return both.withColumn("delta", F.col("value") - base).select("session_id", "lap_num", "channel", "value", "delta")


def robust_offset(df: DataFrame, within: float = 10.0) -> DataFrame:
    """A10: per session, the mean of the offsets within ``within`` of their (upper) median."""
    r = df.withColumn("i", F.row_number().over(Window.partitionBy("session_id").orderBy("offset"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("session_id")))
    med = r.filter(F.col("i") == F.floor(F.col("n") / 2) + 1).select("session_id", F.col("offset").alias("median"))
    return df.join(med, "session_id").filter(F.abs(F.col("offset") - F.col("median")) <= within).groupBy("session_id").agg(F.avg("offset").alias("offset"))
