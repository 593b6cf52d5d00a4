"""The session catalog: files, formats, changes, metadata, search, facets, order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# File extensions and the formats they stand for.
FORMATS = {"xrk": "xrk", "ld": "ld", "log": "wide text", "ibt": "ibt", "adulog": "adulog", "run": "run", "vbo": "sectioned text", "mlg": "mlg"}
# Date and time patterns by format.
STARTED = {"wide text": "MM/dd/yyyy HH:mm:ss", "sectioned text": "dd/MM/yyyy HH:mm:ss", "ld": "dd/MM/yyyy HH:mm:ss", "xrk": "MM/dd/yyyy HH:mm:ss", "ibt": "yyyy-MM-dd HH:mm:ss"}


def detect_format(path: Column) -> Column:
    """The format that a path's extension stands for, in any case; NULL if unknown."""
    ext = F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)$", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), ext)


def scan_catalog(spark: SparkSession, roots: str | list[str]) -> DataFrame:
    """S3: known log files under ``roots``: path, size, mtime, format. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).withColumn("format", detect_format(F.col("path"))).filter("format IS NOT NULL")


def catalog_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """Path and what became of it: new, changed (size or mtime differs), unchanged, deleted."""
    a = new.select("path", F.col("size").alias("s1"), F.col("mtime").alias("m1"))
    b = old.select("path", F.col("size").alias("s0"), F.col("mtime").alias("m0"))
    same = F.col("s1").eqNullSafe(F.col("s0")) & F.col("m1").eqNullSafe(F.col("m0"))
    what = F.when(F.col("s0").isNull(), "new").when(F.col("s1").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", what.alias("change"))


def removed(new: DataFrame, old: DataFrame) -> DataFrame:
    """U4: entries of ``old`` whose path is gone."""
    return old.join(new, "path", "left_anti")


def session_metadata(entries: DataFrame) -> DataFrame:
    """(session_id, format, key, value) rows to one row a session: metadata map, started_at, readable.

    ``readable`` is what the reader said in a column of that name: a session without metadata may well be
    readable. Without that column, sessions with metadata are. Unreadable ones are kept. Of several values of a key the
    smallest counts.
    """
    if "readable" not in entries.columns:
        entries = entries.withColumn("readable", F.col("key").isNotNull())
    said = entries.groupBy("session_id", "format").agg(F.coalesce(F.bool_or("readable"), F.lit(False)).alias("readable"))
    one = entries.groupBy("session_id", "format", "key").agg(F.min("value").alias("value"))
    m = one.groupBy("session_id", "format").agg(F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("key").isNotNull(), F.struct("key", "value"))))).alias("metadata"))
    text = F.concat_ws(" ", F.try_element_at("metadata", F.lit("Log Date")), F.try_element_at("metadata", F.lit("Log Time")))
    at = F.lit(None).cast("timestamp")
    for name, pattern in STARTED.items():
        at = F.when(F.col("format") == name, F.try_to_timestamp(text, F.lit(pattern))).otherwise(at)
    return m.join(said, ["session_id", "format"]).select("session_id", "format", "metadata", at.alias("started_at"), "readable")


def with_venue(sessions: DataFrame, matched: DataFrame, tracks: DataFrame) -> DataFrame:
    """S6 with J8: ``sessions`` whose metadata have the name of their track (``matched``: session_id, track_id; ``tracks``: track_id, name) as Venue.

    A session without a track keeps its metadata as they are.
    """
    own = matched.join(tracks.select("track_id", "name"), "track_id").groupBy("session_id").agg(F.min("name").alias("_venue"))
    rest = F.map_filter("metadata", lambda k, _: k != "Venue")
    named = F.when(F.col("_venue").isNull(), F.col("metadata")).otherwise(F.map_concat(rest, F.create_map(F.lit("Venue"), F.col("_venue"))))
    return sessions.join(own, "session_id", "left").withColumn("metadata", named).drop("_venue")


def _matches(words: Column, text: str) -> Column:
    """Whether each blank-separated term of ``text`` begins some word; * stands for anything."""

    def begins(term: str) -> Column:
        pattern = "^" + "".join(".*" if c == "*" else re.escape(c) for c in term)
        return F.exists(words, lambda w: w.rlike(pattern))

    out = F.lit(True)
    for term in text.lower().split(" "):
        out = out & begins(term)
    return out


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.replace(text, F.lit("_"), F.lit(" "))), r"\s+"), lambda w: w != "")


def search_channels(channels: DataFrame, text: str) -> DataFrame:
    """Channels whose name has, for every term, a word that begins with it; empty text takes any name with a word."""
    return channels.filter(_matches(_words(F.col("channel")), text))


def search_catalog(sessions: DataFrame, text: str = "", facets: dict[str, list[str]] | None = None) -> DataFrame:
    """Readable sessions whose metadata match ``text`` and have, per facet, a value that is chosen."""
    out = sessions.filter("readable").filter(_matches(_words(F.concat_ws(" ", F.map_values("metadata"))), text))
    for key, chosen in (facets or {}).items():
        out = out.filter(F.coalesce(F.try_element_at("metadata", F.lit(key)), F.lit("")).isin(chosen))
    return out


def facets(sessions: DataFrame, keys: tuple[str, ...] = ("Venue", "Driver", "Vehicle")) -> DataFrame:
    """Non-empty values of the facet keys with their number of sessions."""
    return sessions.select(F.explode("metadata").alias("facet", "value")).filter(F.col("facet").isin(*keys) & (F.col("value") != "")).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def session_order(sessions: DataFrame) -> DataFrame:
    """O1: sessions with their ``place`` by start, then by date and time as text; unknown starts come last.

    Places within a day come first, so that no window holds all sessions; then the days' counts add up.
    """
    text = F.concat_ws(" ", F.try_element_at("metadata", F.lit("Log Date")), F.try_element_at("metadata", F.lit("Log Time")))
    s = sessions.withColumn("_day", F.to_date("started_at"))
    own = s.withColumn("_i", F.row_number().over(Window.partitionBy("_day").orderBy("started_at", text, "session_id")))
    by_day = Window.orderBy(F.asc_nulls_last("_day")).rowsBetween(Window.unboundedPreceding, -1)
    days = s.groupBy("_day").count().withColumn("_before", F.coalesce(F.sum("count").over(by_day), F.lit(0))).withColumnRenamed("_day", "_d")
    return own.join(days, own["_day"].eqNullSafe(days["_d"])).select(*sessions.columns, (F.col("_i") + F.col("_before")).cast("long").alias("place"))


def align_clock(sessions: DataFrame, recordings: DataFrame, leap_seconds: float = 18.0) -> DataFrame:
    """Ms from a recording's start to its log's, by wall clock, within half an hour; hours are taken for time zones."""
    delta = F.col("log_s") - leap_seconds - F.col("recording_s")
    return sessions.join(recordings, "session_id").select("session_id", ((F.pmod(delta + 1800, F.lit(3600.0)) - 1800) * 1000).alias("offset_ms"))


def effective_properties(channels: DataFrame, overrides: DataFrame, derived: DataFrame) -> DataFrame:
    """Display properties by channel: the first session's that has it, then override, then derived definition.

    ``channels`` (load_order, channel, units, dec_pts, interpolate); the others by channel, columns nullable.
    """
    props = ("units", "dec_pts", "interpolate")
    first = channels.groupBy("channel").agg(F.min_by(F.struct(*props), F.struct("load_order", *props)).alias("c"))
    o = overrides.select("channel", F.struct(*props).alias("o"))
    d = derived.select("channel", F.struct(*props).alias("d"))
    x = first.join(o, "channel", "left").join(d, "channel", "full_outer")
    return x.select("channel", *[F.coalesce(f"d.{p}", f"o.{p}", f"c.{p}").alias(p) for p in props])


def key_channels(sessions: DataFrame, channels: DataFrame) -> DataFrame:
    """The speed, lat, lon and alt channel names of each session, NULL where the channel is absent."""
    roles = ("key_speed", "key_lat", "key_lon", "key_alt")
    named = sessions.select("session_id", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("channel")) for r in roles])).alias("x")).select("session_id", "x.*")
    held = named.join(channels.select("session_id", "channel").distinct(), ["session_id", "channel"], "left_semi")
    out = held.groupBy("session_id").pivot("role", list(roles)).agg(F.first("channel"))
    return sessions.select("session_id").join(out, "session_id", "left")
