"""Telemetry views of the driver's tables, in Spark and as SQL text for the comparison.

A user of ``events`` is a session, an event type a channel, and a second counts as a
millisecond, so 30 days make a session of 43 minutes. Running sign-ups are the lap counter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.distance import build_dist_map, with_lap_distances
from ..operators.laps import laps_from_counter
from ..sources.storage import kept

GRID_MS = 1000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def out(df: DataFrame, digits: int = 6) -> DataFrame:
    """Integers as BIGINT, doubles rounded (and zero without a sign): what both engines can be compared on."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        cols.append((c.cast("bigint") if kind in ("int", "smallint", "tinyint") else F.round(c, digits) + 0.0 if kind in ("double", "float") else c).alias(name))
    return df.select(cols)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    tc = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 1e6D")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("channel"), tc.alias("tc"), "value", "event_id", "props", "ts")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("session_id", "channel", "tc", "value")


def counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Window.partitionBy("session_id").orderBy("tc", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = events(spark, sf_dir)
    return e.select("session_id", F.lit("laps").alias("channel"), "tc", F.sum((F.col("channel") == "signup").cast("double")).over(run).alias("value"))


def laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laps_from_counter(counter(spark, sf_dir), "laps")


def speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).filter("channel = 'click'").select("session_id", "tc", "value")


def dist_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_dist_map(speed(spark, sf_dir), kept(laps(spark, sf_dir), "laps"), GRID_MS)


def mapped_laps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Laps with distances, and the distance map: each built once and kept for what follows."""
    own = kept(laps(spark, sf_dir), "laps")
    found = kept(build_dist_map(speed(spark, sf_dir), own, GRID_MS), "dist_map")
    return with_lap_distances(own, found, GRID_MS), found


def dist_laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped_laps(spark, sf_dir)[0]


#: Sessions whose positions one task gets: 601 000 rows.
SESSIONS_A_TASK = 1000


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions once a second on an ellipse around (45, 9), a lap each minute or so."""
    # Sessions are few bytes but hundreds of positions each: dealt by session only once they are made, they are spread over
    # tasks, and judged small or large in joins, by their own size. (By the key alone the second shuffle would be left out.)
    # Written they are few bytes a row, sorted many: tasks are as many as their rows need, not their bytes.
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.xxhash64("user_id").alias("_h")).distinct()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-users.count() // SESSIONS_A_TASK))
    # Sessions are so few bytes that without a number one task would make all positions.
    x = users.repartition(n, "_h").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(600))))
    a = 2 * F.pi() * (F.col("i") + 0.37) / (60 + F.col("session_id") % 7)
    x = x.select("session_id", (F.col("i") * 1000.0).alias("tc"), (45 + 0.004 * F.sin(a)).alias("lat"), (9 + 0.006 * F.cos(a)).alias("lon"))
    return x.repartition(n, "session_id").withColumn("alt", F.lit(0.0))


# SQL text of the views, in order of use.
VIEWS = {
    "ev": "SELECT user_id AS session_id, event_type AS channel, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 AS tc, value, event_id, props, ts FROM events",
    "fx_samples": "SELECT session_id, channel, tc, value FROM ev",
    "fx_counter": "SELECT session_id, tc, sum(CASE WHEN channel = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY tc, event_id) AS value FROM ev",
    "fx_marks": "SELECT session_id, value, CASE WHEN before IS NULL THEN 0.0 ELSE tc END AS start_tc FROM (SELECT *, lag(value) OVER (PARTITION BY session_id ORDER BY tc) AS before FROM fx_counter) WHERE before IS NULL OR before <> value",
    "fx_ends": "SELECT session_id, max(tc) AS session_end FROM ev GROUP BY session_id",
    "fx_laps": "SELECT session_id, CAST(first_value(value) OVER w + row_number() OVER w - 1 AS BIGINT) AS lap_num, start_tc, coalesce(lead(start_tc) OVER w, session_end) AS end_tc FROM fx_marks JOIN fx_ends USING (session_id) WINDOW w AS (PARTITION BY session_id ORDER BY start_tc)",
    "fx_speed": "SELECT session_id, tc, value FROM fx_samples WHERE channel = 'click'",
    # The distance map as the literal grid: one row per grid point.
    "fx_gridlaps": "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_tc) AS i, count(*) OVER (PARTITION BY session_id) AS n, CAST(round_even(start_tc / 1000, 0) AS BIGINT) AS k FROM fx_laps",
    "fx_kend": "SELECT session_id, CAST(ceil(max(end_tc) / 1000) AS BIGINT) AS k_end FROM fx_laps GROUP BY session_id",
    "fx_points": "SELECT session_id, k, k * 1000.0 AS tc FROM (SELECT session_id, unnest(range(0, k_end)) AS k FROM fx_kend)",
    "fx_prev": "SELECT p.session_id, p.k, p.tc, s.tc AS t0, s.value AS v0 FROM fx_points p ASOF LEFT JOIN fx_speed s ON p.session_id = s.session_id AND p.tc >= s.tc",
    "fx_next": "SELECT p.session_id, p.k, p.tc, p.t0, p.v0, s.tc AS t1, s.value AS v1 FROM fx_prev p ASOF LEFT JOIN fx_speed s ON p.session_id = s.session_id AND p.tc <= s.tc",
    "fx_grid": "SELECT n.session_id, n.k, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (n.tc - t0) / (t1 - t0) END AS v, l.lap_num, l.i > 1 AND l.i < l.n AS inner_lap FROM fx_next n ASOF LEFT JOIN fx_gridlaps l ON n.session_id = l.session_id AND n.k >= l.k",
    "fx_len": "SELECT session_id, lap_num, sum(v) AS len FROM fx_grid WHERE inner_lap GROUP BY session_id, lap_num",
    "fx_factor": "SELECT session_id, lap_num, CASE WHEN abs(len - med) / med <= 0.05 THEN med / len ELSE 1.0 END AS factor FROM fx_len JOIN (SELECT session_id, median(len) AS med FROM fx_len GROUP BY session_id) USING (session_id)",
    "fx_dist": "SELECT g.session_id, g.k, sum(v * coalesce(factor, 1.0)) OVER (PARTITION BY g.session_id ORDER BY g.k) AS dist FROM fx_grid g LEFT JOIN fx_factor f ON g.session_id = f.session_id AND g.lap_num = f.lap_num",
    "fx_top": "SELECT session_id, max(k) AS k_last, max(dist) AS d_last FROM fx_dist GROUP BY session_id",
    "fx_at": "SELECT session_id, lap_num, 's' AS side, start_tc AS tc FROM fx_laps UNION ALL SELECT session_id, lap_num, 'e', end_tc FROM fx_laps",
    "fx_atd": "SELECT a.session_id, lap_num, side, CASE WHEN floor(a.tc / 1000) >= k_last THEN d_last ELSE d.dist + (a.tc / 1000 - floor(a.tc / 1000)) * (e.dist - d.dist) END AS dist FROM fx_at a JOIN fx_top USING (session_id) LEFT JOIN fx_dist d ON d.session_id = a.session_id AND d.k = CAST(floor(a.tc / 1000) AS BIGINT) LEFT JOIN fx_dist e ON e.session_id = a.session_id AND e.k = CAST(floor(a.tc / 1000) AS BIGINT) + 1",
    "fx_dlaps": "SELECT l.*, s.dist AS start_dist, e.dist AS end_dist FROM fx_laps l JOIN fx_atd s ON s.session_id = l.session_id AND s.lap_num = l.lap_num AND s.side = 's' JOIN fx_atd e ON e.session_id = l.session_id AND e.lap_num = l.lap_num AND e.side = 'e'",
    # Grid points of one distance, to the micrometre, as one place: where a session stood still it has a first and a last.
    "fx_places": "SELECT session_id, round(dist, 6) AS at, max(k) AS k_hi, arg_max(dist, k) AS d_hi, min(k) AS k_lo, arg_min(dist, k) AS d_lo FROM fx_dist GROUP BY session_id, round(dist, 6)",
    "fx_fixes": "SELECT session_id, i * 1000.0 AS tc, 45 + 0.004 * sin(a) AS lat, 9 + 0.006 * cos(a) AS lon FROM (SELECT session_id, i, 2 * pi() * (i + 0.37) / (60 + session_id % 7) AS a FROM (SELECT DISTINCT user_id AS session_id FROM events), (SELECT unnest(range(0, 601)) AS i))",
}


def sql(body: str) -> str:
    """``body`` with the views it needs, and those that they need, ahead of it."""
    import re

    body = body.lstrip()
    wanted: set[str] = set()

    def need(text: str) -> None:
        for name in set(re.findall(r"\b(?:ev|fx_\w+)\b", text)) & VIEWS.keys() - wanted:
            wanted.add(name)
            need(VIEWS[name])

    need(body)
    views = ", ".join(f"{k} AS ({v})" for k, v in VIEWS.items() if k in wanted)
    if not views:
        return body
    for word in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(word):
            return f"{word}{views}, {body[len(word) :]}"
    return f"WITH {views} {body}"
