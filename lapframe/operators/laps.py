"""Laps: from counters, odometers, beacons and messages; best laps and lap tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..sources.storage import sorted_join
from .align import assign_laps
from .buckets import BUCKET_MS, bucket, edges, within


def _by_session() -> WindowSpec:
    return Window.partitionBy("session_id")


def laps_from_counter(samples: DataFrame, channel: str, width: float = BUCKET_MS) -> DataFrame:
    """A lap begins wherever the counter changes; the first at 0, the last ends with the session.

    Laps are numbered on from the counter's first value. Changes are found within buckets of time; only
    they, a few for each lap, are put in order over the session.
    """
    ends = samples.groupBy("session_id").agg(F.max("tc").alias("session_end"))
    own = samples.filter((F.col("channel") == channel) & F.col("value").isNotNull()).select("session_id", "tc", F.struct(F.col("tc").cast("double").alias("_on"), "value").alias("s"))
    own = own.withColumn("_bucket", bucket(F.col("tc"), width)).withColumn("_side", F.lit(0))
    own = own.unionByName(edges(own, ("session_id",), ["s"]).filter("_side < 0"), allowMissingColumns=True)
    marks = own.withColumn("before", F.lag("s.value").over(within(("session_id",), "s"))).filter("_side = 0").select("session_id", "tc", "s.value", "before")
    marks = marks.filter(F.col("before").isNull() | (F.col("before") != F.col("value")))
    marks = marks.select("session_id", "value", F.when(F.col("before").isNull(), 0.0).otherwise(F.col("tc")).alias("start_tc"))
    by_start = _by_session().orderBy("start_tc")
    laps = marks.select(
        "session_id",
        (F.first("value").over(by_start.rowsBetween(Window.unboundedPreceding, 0)) + F.row_number().over(by_start) - 1).cast("int").alias("lap_num"),
        "start_tc",
        F.lead("start_tc").over(by_start).alias("next_tc"),
    )
    return laps.join(ends, "session_id").select("session_id", "lap_num", "start_tc", F.coalesce("next_tc", "session_end").alias("end_tc"))


def laps_from_odometer(wide: DataFrame) -> DataFrame:
    """``wide`` has session_id, tc, lap, lap_dist (m), speed (m/s) per sample.

    A change of the lap channel is put back to where the lap distance was zero, though not
    before the sample ahead of it; a change to lap 0 ends the session's laps.
    """
    by_tc = _by_session().orderBy("tc")
    x = wide.withColumn("lap0", F.lag("lap").over(by_tc)).withColumn("tc0", F.lag("tc").over(by_tc))
    last = wide.groupBy("session_id").agg(F.max("tc").alias("session_end"))
    b = x.filter(F.col("lap0") != F.col("lap"))
    at = F.when(F.col("lap") == 0, F.col("tc")).otherwise(F.greatest("tc0", F.col("tc") - F.coalesce(F.try_divide("lap_dist", "speed"), F.lit(0.0)) * 1000))
    b = b.select("session_id", "tc", "lap", at.alias("at"))
    stopped = F.coalesce(F.max(F.when(F.col("lap") == 0, 1)).over(by_tc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    b = b.withColumn("stopped", stopped).filter("stopped = 0").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("tc", "at", "lap"))).alias("m"))
    # Tens of marks to a session.
    cut = last.join(b, "session_id", "left")
    marks = F.transform(F.coalesce("m", F.array().cast("array<struct<tc:double,at:double,lap:double>>")), lambda m: m["at"])
    ended = F.coalesce(F.element_at("m", -1)["lap"] == 0, F.lit(False))
    marks = F.concat(F.array(F.lit(0.0)), marks, F.when(ended, F.array().cast("array<double>")).otherwise(F.array("session_end")))
    laps = cut.select("session_id", marks.alias("marks")).select("session_id", "marks", F.posexplode(F.slice("marks", 1, F.size("marks") - 1)).alias("lap_num", "start_tc"))
    return laps.select("session_id", "lap_num", "start_tc", F.get("marks", F.col("lap_num") + 1).alias("end_tc"))


def laps_from_beacon(samples: DataFrame, channel: str = "Beacon") -> DataFrame:
    """Laps between coded beacon sequences.

    A sequence starts at a negative value, may carry a 14-bit signed offset (a value of 16384
    or more), and ends at any other value; an end of 100 or 2 marks a lap at start - 1000 + offset.
    """
    by_tc = _by_session().orderBy("tc")
    ends = samples.groupBy("session_id").agg(F.max("tc").alias("session_end"))
    b = samples.filter(F.col("channel") == channel)
    done = (F.col("value") >= 0) & (F.col("value") < 16384)
    b = b.withColumn("grp", F.coalesce(F.sum(done.cast("int")).over(by_tc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    in_grp = Window.partitionBy("session_id", "grp").orderBy("tc").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("start", F.min(F.when(F.col("value") < 0, F.col("tc"))).over(in_grp))
    seen = F.when((F.col("value") >= 16384) & F.col("start").isNotNull(), F.col("value").cast("long"))
    b = b.withColumn("code", F.last(seen, ignorenulls=True).over(by_tc.rowsBetween(Window.unboundedPreceding, 0)))
    low = F.col("code").bitwiseAND(16383)
    offset = F.when(low >= 8192, low - 16384).otherwise(low)
    marks = b.filter(F.col("value").isin(100, 2) & F.col("start").isNotNull() & F.col("code").isNotNull()).select("session_id", (F.col("start") - 1000 + offset).alias("m"))
    marks = marks.groupBy("session_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    cuts = ends.join(marks, "session_id", "left").select("session_id", F.concat(F.array(F.lit(0.0)), F.coalesce("m", F.array().cast("array<double>")), F.array("session_end")).alias("c"))
    laps = cuts.select("session_id", "c", F.posexplode(F.slice("c", 1, F.size("c") - 1)).alias("lap_num", "start_tc"))
    return laps.select("session_id", "lap_num", F.floor("start_tc").cast("double").alias("start_tc"), F.floor(F.get("c", F.col("lap_num") + 1)).cast("double").alias("end_tc"))


def laps_from_messages(messages: DataFrame) -> DataFrame:
    """``messages`` (session_id, seq, segment, lap, duration, end_tc) to laps.

    Segments and repeats of a lap are skipped; one missing lap is inferred from its
    neighbours; a larger gap raises an error.
    """
    by_seq = _by_session().orderBy("seq")
    m = messages.filter("segment = 0").withColumn("lap0", F.lag("lap").over(by_seq))
    m = m.filter(F.col("lap0").isNull() | (F.col("lap0") != F.col("lap"))).withColumn("end0", F.lag("end_tc").over(by_seq))
    gap = F.col("lap") - F.col("lap0")
    start = F.col("end_tc") - F.col("duration")
    own = F.struct(F.col("lap").cast("int").alias("lap_num"), start.cast("double").alias("start_tc"), F.col("end_tc").cast("double").alias("end_tc"))
    missing = F.struct((F.col("lap") - 1).cast("int").alias("lap_num"), F.col("end0").cast("double").alias("start_tc"), start.cast("double").alias("end_tc"))
    bad = F.raise_error(F.concat(F.lit("lap gap from "), F.col("lap0").cast("string"), F.lit(" to "), F.col("lap").cast("string"))).cast(f"array<{'struct<lap_num:int,start_tc:double,end_tc:double>'}>")
    rows = F.when(gap.isNull() | (gap == 1), F.array(own)).when(gap == 2, F.array(missing, own)).otherwise(bad)
    return m.select("session_id", F.explode(rows).alias("l")).select("session_id", "l.*")


def lap_distances(laps: DataFrame) -> DataFrame:
    """A5: distance of each lap (laps with start_dist, end_dist) and the median of inner laps."""
    by_num = _by_session().orderBy("lap_num")
    x = laps.withColumn("dist", F.col("end_dist") - F.col("start_dist")).withColumn("i", F.row_number().over(by_num)).withColumn("n", F.count(F.lit(1)).over(_by_session()))
    inner = (F.col("i") > 1) & (F.col("i") < F.col("n"))
    med = x.filter(inner).groupBy("session_id").agg(F.median("dist").alias("median_dist"))
    return x.join(med, "session_id", "left").select("session_id", "lap_num", "dist", "median_dist")


def best_lap(laps: DataFrame) -> DataFrame:
    """The best lap of each session (laps with start_tc, end_tc, start_dist, end_dist).

    Of one or two laps the shortest; of more, the shortest inner lap of at least 0.95 times the
    inner laps' median distance, in micrometres. The earliest of equals.
    """
    by_num = _by_session().orderBy("lap_num")
    x = laps.withColumn("dur", F.col("end_tc") - F.col("start_tc")).withColumn("dist", F.round(F.col("end_dist") - F.col("start_dist"), 6))
    x = x.withColumn("i", F.row_number().over(by_num)).withColumn("n", F.count(F.lit(1)).over(_by_session()))
    x = x.filter((F.col("n") <= 2) | ((F.col("i") > 1) & (F.col("i") < F.col("n"))))
    med = x.groupBy("session_id").agg(F.median("dist").alias("median_dist"))
    x = x.join(sorted_join(med), "session_id").filter((F.col("n") <= 2) | (F.col("dist") >= 0.95 * F.col("median_dist")))
    best = x.groupBy("session_id").agg(F.min(F.struct("dur", "lap_num", "start_tc", "end_tc")).alias("b"))
    return best.select("session_id", "b.lap_num", "b.start_tc", "b.end_tc", F.col("b.dur").alias("duration"))


def top_laps(laps: DataFrame, n: int = 3) -> DataFrame:
    """O2: each session's n shortest laps, ranked."""
    x = laps.withColumn("duration", F.col("end_tc") - F.col("start_tc"))
    x = x.withColumn("rank", F.row_number().over(_by_session().orderBy("duration", "lap_num")))
    return x.filter(F.col("rank") <= n).select("session_id", "lap_num", "duration", "rank")


def lap_table(laps: DataFrame, best: DataFrame) -> DataFrame:
    """Every lap with its duration, the gap to the session's best and to the fleet's, and whether it is the best."""
    fleet = best.agg(F.min("duration").alias("fleet_best"))
    b = best.select("session_id", F.col("lap_num").alias("best_num"), F.col("duration").alias("best"))
    x = laps.withColumn("duration", F.col("end_tc") - F.col("start_tc")).join(b, "session_id", "left").join(F.broadcast(fleet))
    return x.select("session_id", "lap_num", "start_tc", "duration", (F.col("duration") - F.col("best")).alias("delta"), (F.col("duration") - F.col("fleet_best")).alias("fleet_delta"), (F.col("lap_num") == F.col("best_num")).alias("is_best"))


def lap_stats(samples: DataFrame, laps: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """A2: min, max and count per lap and channel; with ``reference`` (session_id, lap_num), gaps to that lap's."""
    own = assign_laps(samples, laps).groupBy("session_id", "lap_num", "channel").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count("value").alias("n"))
    if reference is None:
        return own
    ref = own.join(reference, ["session_id", "lap_num"]).select("session_id", "channel", F.col("min_value").alias("ref_min"), F.col("max_value").alias("ref_max"))
    return own.join(ref, ["session_id", "channel"], "left").select("session_id", "lap_num", "channel", "min_value", "max_value", "n", (F.col("min_value") - F.col("ref_min")).alias("min_delta"), (F.col("max_value") - F.col("ref_max")).alias("max_delta"))
