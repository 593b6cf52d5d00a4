"""The made positions of the test tables reach joins and windows as the rows they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapframe.operators import normalize
from lapframe.plans import fixtures


def test_positions_are_dealt_after_they_are_made(spark, tmp_path):
    spark.range(40).select((F.col("id") % 20).alias("user_id")).write.parquet(f"{tmp_path}/events.parquet")
    made = fixtures.fixes(spark, str(tmp_path))
    assert made.columns == ["session_id", "tc", "lat", "lon", "alt"] and made.count() == 20 * 601
    plan = made._jdf.queryExecution().executedPlan().toString()
    # Outermost first: a shuffle of the positions themselves, then what makes them of sessions.
    assert 0 <= plan.find("hashpartitioning(session_id") < plan.find("Generate explode")


def test_positions_have_as_many_tasks_as_their_sessions_need(spark, tmp_path):
    spark.range(5001).select(F.col("id").alias("user_id")).write.parquet(f"{tmp_path}/events.parquet")
    assert fixtures.fixes(spark, str(tmp_path)).rdd.getNumPartitions() == 6


def test_sentinels_go_without_a_join(spark):
    rows = [(1, 0.0, "lat", 0.0), (1, 0.0, "lon", 0.0), (1, 0.0, "alt", 5.0), (1, 0.0, "v", 0.0), (1, 1.0, "lat", 0.0), (1, 1.0, "lon", 9.0), (None, 0.0, "lat", 0.0), (None, 0.0, "lon", 0.0)]
    kept = normalize.drop_gps_sentinels(spark.createDataFrame(rows, "session_id long, tc double, channel string, value double"), "lat", "lon", "alt")
    assert sorted((str(r.session_id), r.tc, r.channel) for r in kept.collect()) == [("1", 0.0, "v"), ("1", 1.0, "lat"), ("1", 1.0, "lon"), ("None", 0.0, "lat"), ("None", 0.0, "lon")]
    assert "Join" not in kept._jdf.queryExecution().executedPlan().toString()
