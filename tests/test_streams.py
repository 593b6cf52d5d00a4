"""Streaming jobs: ingestion with files that fail, laps by event time, windows in append mode."""

from __future__ import annotations

import os
import shutil

import pytest
from pyspark.sql import functions as F

from lapframe.sources import catalog, storage, text_logs
from lapframe.streaming import jobs

HEAD = '"Interval"|"ms","Utc"|"ms","LapCount"|"","Speed"|"km/h"\n'


def wide(rows):
    return HEAD + "".join(",".join(map(str, r)) + "\n" for r in rows)


@pytest.fixture
def logs(tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text(wide([(100, 1700000000000, 0, 10.5), (200, "", 0, ""), (300, "", 1, 12.5), (400, "", 1, 11)]))
    (folder / "noclock.log").write_text('"Interval"|"ms","Speed"|"km/h"\n5,4\n15,6\n')
    (folder / "empty.log").write_text(HEAD)
    (folder / "b.vbo").write_text("File created on 03/02/2024 at 10:11:12\n[header]\ntime\nboost\n\n[channel units]\nkPa\n[data]\n000000.000 1.5\n000001.000 1.6\n")
    (folder / "c.xrk").write_bytes(b"binary")
    (folder / "notes.txt").write_text("no log")
    return folder


def name(path):
    return os.path.basename(path)


def test_ingestion_writes_all_tables_and_repeats_nothing(spark, logs, tmp_path):
    tables, state = str(tmp_path / "tables"), str(tmp_path / "state")
    run = lambda: jobs.stream_catalog(spark, str(logs), tables, state).awaitTermination()
    run()
    read = lambda t: spark.read.option("recursiveFileLookup", True).parquet(f"{tables}/{t}")
    status = lambda: {name(r.path): (r.status, r.n_samples) for r in read("catalog").collect()}
    assert status() == {"a.log": ("read", 8), "noclock.log": ("read", 2), "empty.log": ("empty", 0), "b.vbo": ("read", 2), "c.xrk": ("no reader", 0)}
    assert {(name(r.path), r.lap_num, r.start_tc, r.end_tc) for r in read("laps").collect()} == {("a.log", 0, 0.0, 200.0), ("a.log", 1, 200.0, 300.0)}
    meta = {name(r.path): r.metadata for r in read("metadata").collect()}
    assert meta["a.log"]["Log Date"] == "11/14/2023" and meta["b.vbo"]["Log Time"] == "10:11:12" and meta["noclock.log"] == {}
    assert {(name(r.path), r.channel, r.min_value, r.max_value, r.n) for r in read("channels").collect()} >= {("a.log", "Speed", 10.5, 12.5, 3), ("noclock.log", "Speed", 4.0, 6.0, 2)}
    # A new file comes in a batch of its own; nothing is read again.
    (logs / "d.log").write_text(wide([(0, "", 3, 1), (10, "", 4, 2)]))
    run()
    assert status()["d.log"] == ("read", 4) and len(read("catalog").collect()) == 6
    # A batch that is run again (its commit was lost) overwrites itself.
    before = {t: sorted(map(str, read(t).collect())) for t in ("samples", "laps", "metadata", "channels", "catalog")}
    commits = sorted(os.listdir(f"{state}/commits"))
    for f in (commits[-1], f".{commits[-1]}.crc"):
        if os.path.exists(f"{state}/commits/{f}"):
            os.remove(f"{state}/commits/{f}")
    last = max((f for f in os.listdir(f"{state}/commits") if f.isdigit()), key=int)
    for f in (last, f".{last}.crc"):
        if os.path.exists(f"{state}/commits/{f}"):
            os.remove(f"{state}/commits/{f}")
    run()
    assert {t: sorted(map(str, read(t).collect())) for t in before} == before


def test_a_file_whose_reader_raises_stands_alone(spark, logs, tmp_path, monkeypatch):
    def picky(spark, paths):
        if any("noclock" in p for p in paths):
            raise ValueError("no clock in it")
        return text_logs.read_wide_log(spark, paths, tolerant=True)

    monkeypatch.setitem(jobs._READERS, "wide text", picky)
    tables = str(tmp_path / "tables")
    jobs.stream_catalog(spark, str(logs), tables, str(tmp_path / "state")).awaitTermination()
    got = {name(r.path): (r.status, r.reason, r.n_samples) for r in spark.read.parquet(f"{tables}/catalog").collect()}
    assert got["noclock.log"] == ("failed", "no clock in it", 0) and got["a.log"] == ("read", None, 8) and got["b.vbo"][0] == "read"


def test_logs_without_a_clock_are_readable(spark, logs):
    m = text_logs.log_metadata(spark, [str(logs / f) for f in ("a.log", "noclock.log", "b.vbo")]).withColumnRenamed("path", "session_id")
    by = {name(r.session_id): r for r in catalog.session_metadata(m).collect()}
    assert by["noclock.log"].readable and by["noclock.log"].metadata == {} and by["a.log"].readable and by["b.vbo"].readable
    bad = spark.createDataFrame([("x", "wide text", None, None, False)], "session_id string, format string, key string, value string, readable boolean")
    assert [r.readable for r in catalog.session_metadata(bad).collect()] == [False]


def feed(spark, folder, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


LAPS = "session_id string, ts timestamp, tc double, value double"


def sample(session, s, value):
    import datetime

    return (session, datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=s), s * 1000.0, float(value))


def test_laps_of_samples_out_of_order_with_timeout_and_restart(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("source", "out", "state"))

    def run(batches):
        s = jobs.stream_laps(feed(spark, source, batches, LAPS), "20 seconds", 60_000)
        q = s.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.session_id, r.lap_num, r.start_tc, r.end_tc) for r in spark.read.schema("session_id string, lap_num long, start_tc double, end_tc double").parquet(out).collect())

    # Session a: laps 3, 4, 5; the sample at 12 s that begins lap 4 comes a batch late and the one at 30 s ahead of its time.
    first = run([[sample("a", 0, 3), sample("a", 14, 4), sample("a", 30, 5)], [sample("a", 12, 4), sample("a", 18, 4), sample("b", 40, 1)]])
    assert first == [("a", 3, 0.0, 12_000.0)]
    # Restarted from its checkpoint. A sample of a time long past is dropped; a hundred seconds later session a has ended.
    later = run([[sample("a", 29, 4), sample("b", 45, 2)], [sample("a", 1, 9), sample("b", 150, 2)], [sample("b", 151, 2)]])
    assert later == [("a", 3, 0.0, 12_000.0), ("a", 4, 12_000.0, 30_000.0), ("a", 5, 30_000.0, 30_000.0), ("b", 1, 0.0, 45_000.0)]
    # It goes on as a session anew.
    last = run([[sample("a", 160, 7), sample("b", 170, 2)], [sample("b", 300, 3)]])
    assert last[:-2] == later[:3] and ("a", 7, 0.0, 160_000.0) in last
    shutil.rmtree(out)


def test_sliding_windows_in_append_mode_drop_late_rows(spark, tmp_path):
    kind = "session_id string, channel string, ts timestamp, value double"
    row = lambda s, v: ("a", "x", sample("a", s, 0)[1], float(v))
    batches = [[row(5, 1), row(12, 2)], [row(100, 3), row(8, 4)], [row(200, 5)], [row(9, 99), row(300, 6)]]
    stats = jobs.stream_channel_stats(feed(spark, str(tmp_path / "in"), batches, kind), "20 seconds", "10 seconds", "30 seconds")
    q = stats.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.at: (r.min_value, r.max_value, r.n) for r in spark.read.schema(stats.schema).parquet(str(tmp_path / "out")).select((F.unix_timestamp("window_start") - 1704067200).alias("at"), "*").collect()}
    assert got == {-10: (1.0, 4.0, 2), 0: (1.0, 4.0, 3), 10: (2.0, 2.0, 1), 90: (3.0, 3.0, 1), 100: (3.0, 3.0, 1), 190: (5.0, 5.0, 1), 200: (5.0, 5.0, 1)}
    assert jobs.dropped_rows(q) > 0


def test_buckets_prune_folders(spark, tmp_path):
    s = spark.createDataFrame([(i, "a", 0.0, float(i)) for i in range(64)], "session_id long, channel string, tc double, value double")
    storage.write_samples(s, str(tmp_path / "s"), buckets=16)
    got = storage.read_samples(spark, str(tmp_path / "s"), sessions=[3, 5], buckets=16)
    assert sorted(r.session_id for r in got.collect()) == [3, 5]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("PartitionFilters: [bucket", "PartitionFilters: [isnotnull(bucket") and "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
    storage.write_small(s.limit(3), str(tmp_path / "small"), "json")
    assert spark.read.json(str(tmp_path / "small")).count() == 3


def test_logs_are_written_to_a_folder_for_many(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "LOGS_A_TASK", 10)
    lines = spark.range(300).select((F.col("id") % 60).alias("session_id"), (-F.col("id")).cast("double").alias("o"), F.concat(F.lit("é "), F.col("id").cast("string")).alias("value"))
    storage.write_logs(lines, f"file://{tmp_path}/logs")
    folders = os.listdir(tmp_path / "logs")
    files = {f: (tmp_path / "logs" / d / f).read_text() for d in folders for f in os.listdir(tmp_path / "logs" / d)}
    assert len(folders) <= 6 and len(files) == 60
    assert files["session_id=7.log"] == "é 247\né 187\né 127\né 67\né 7\n"


def test_a_batch_without_a_counter_looks_for_no_laps(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "x.log").write_text('"Interval"|"ms","Speed"|"km/h"\n5,4\n15,6\n')
    seen = []
    own = jobs.laps_from_counter
    jobs.laps_from_counter = lambda *a: (seen.append(1), own(*a))[1]
    try:
        jobs.stream_catalog(spark, str(tmp_path / "logs"), str(tmp_path / "tables"), str(tmp_path / "state")).awaitTermination()
    finally:
        jobs.laps_from_counter = own
    laps = spark.read.parquet(f"{tmp_path}/tables/laps")
    assert not seen and laps.count() == 0 and dict(laps.dtypes)["lap_num"] == "int"


def test_a_batch_of_a_fed_table_is_many_files(spark, monkeypatch):
    from lapframe.plans import more

    monkeypatch.setattr(more, "FED_A_FILE", 100)
    df = spark.range(1200).select("id", (F.col("id") % 3).cast("int").alias("part"))
    seen = []
    note = lambda b, i: seen.append((b.select(F.col("_metadata.file_path")).distinct().count(), sorted(r.id for r in b.select("id").collect())))
    s = more._fed(df, spark, "fed", F.col("part")).select("id", "_metadata")
    s.writeStream.foreachBatch(note).option("checkpointLocation", more.scratch(spark, "fed-state")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [(5, list(range(i, 1200, 3))) for i in range(3)]
