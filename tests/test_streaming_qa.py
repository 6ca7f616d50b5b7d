"""Streams against their batch forms, sound files, and edge checks."""

import datetime as dt
import struct

from pyspark.sql import functions as F

from cutlist.operators import progress, qa
from cutlist.sources import audio
from cutlist.streaming import stream


def written(spark, df, tmp_path, name, parts=3):
    """A stream of ``df`` in so many triggers, in the order of its rows."""
    rows = df.collect()
    for k in range(parts):
        some = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        spark.createDataFrame(some, df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")


def collected(stream_df, name, mode, tmp_path):
    q = stream_df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck_{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream_df.sparkSession.table(name)


def test_streams_agree_with_batches(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k % 2, k % 5, k, t0 + dt.timedelta(milliseconds=70 * k), ("rendering", "done", "error")[k % 3], float(k % 101), k % 9 == 0, k % 4) for k in range(120)]
    ev = spark.createDataFrame(rows, "batch_id long, job_id long, seq long, ts timestamp, status string, pct double, force_emit boolean, run_id long")
    source = written(spark, ev, tmp_path, "events")
    want = {tuple(r) for r in progress.latest(ev).collect()}
    assert {tuple(r) for r in collected(stream.latest_progress(source), "latest", "complete", tmp_path).collect()} == want
    kept = f"{tmp_path}/kept"
    stream.overall_progress(source, kept, f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)
    assert {tuple(r) for r in stream.overall(spark, kept).collect()} == {tuple(r) for r in progress.overall(progress.latest(ev)).collect()}
    # three triggers, each with the jobs and batches that it changed and no more
    for part, key in (("jobs", lambda r: (r[0], r[1])), ("totals", lambda r: r[0])):
        sizes = {r.v: r["count"] for r in spark.read.parquet(f"{kept}/{part}/log").groupBy("v").count().collect()}
        assert sizes == {k: len({key(r) for r in rows[40 * k : 40 * k + 40]}) for k in range(3)}
    got = collected(stream.throttle(source), "throttled", "append", tmp_path)
    assert sorted(r.seq for r in got.collect()) == sorted(r.seq for r in progress.throttle(ev).collect())
    got = sorted(r.seq for r in collected(stream.drop_superseded(source), "newest", "append", tmp_path).collect())
    newest, want = {}, []
    for part in (rows[:40], rows[40:80], rows[80:]):
        for r in part:
            newest[r[1]] = max(newest.get(r[1], r[7]), r[7])
        want += [r[2] for r in part if r[7] == newest[r[1]]]
    assert got == sorted(want)


def test_stream_state_is_carried_over_triggers(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(0, k, k, t0 + dt.timedelta(milliseconds=150 * k), "done", 1.0, False, 5 - k) for k in range(6)]
    ev = spark.createDataFrame(rows, "batch_id long, job_id long, seq long, ts timestamp, status string, pct double, force_emit boolean, run_id long")
    got = collected(stream.throttle(written(spark, ev, tmp_path, "one", 6)), "one_each", "append", tmp_path)
    assert sorted(r.seq for r in got.collect()) == [0, 2, 4]  # without state each trigger's event would be sent
    same = ev.withColumn("job_id", F.lit(1).cast("long"))
    got = collected(stream.drop_superseded(written(spark, same, tmp_path, "two", 6)), "falling", "append", tmp_path)
    assert [r.seq for r in got.collect()] == [0]  # the first run is the newest, all others come too late


def test_classified_stream(spark, tmp_path):
    lines = spark.createDataFrame([("moov atom not found",), ("other",)], "raw string")
    assert {r.code for r in collected(stream.classify_errors(written(spark, lines, tmp_path, "lines", 2)), "lines", "append", tmp_path).collect()} == {"damaged", "generic"}


def test_wav(spark):
    pcm = struct.pack("<600h", *([0] * 100 + [16384] + [0] * 411 + [-32768] + [0] * 87))
    riff = b"RIFF\0\0\0\0WAVE" + b"fmt " + struct.pack("<I", 16) + b"\0" * 16 + b"odd " + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(pcm)) + pcm
    files = spark.createDataFrame([("/a", bytearray(riff)), ("/b", bytearray(b"RIFF0000WAVE"))], "path string, content binary")
    rows = audio.decode_wav(files).orderBy("path", "frame").collect()
    assert [(r.path, r.frame, r.peak) for r in rows[:2]] == [("/a", 0, 0.5), ("/a", 1, 1.0)] and rows[2].error == "no data chunk"


def test_edge_checks(spark):
    say = [("s", i, t, a, a + 0.3) for i, (t, a) in enumerate([("hook", 0.0), ("one", 0.4), *[(f"w{k}", 1.0 + 0.4 * k) for k in range(12)], ("plain", 20.0), *[(f"v{k}", 20.5 + 0.4 * k) for k in range(12)]])]
    source = spark.createDataFrame(say, "source_id string, idx int, text string, start double, end double")
    clips = spark.createDataFrame([("s", "dirty", "meat", 0.0, 6.0), ("s", "clean", "hook", 20.0, 26.0)], "source_id string, clip_id string, bucket string, source_start double, source_end double")
    rows = {r.clip_id: r for r in qa.run(clips, source).collect()}
    assert rows["clean"].status == "clean" and rows["clean"].confidence == 0.95
    # "hook one" leads into a meat clip: one cut past the words of the edge mends it
    dirty = rows["dirty"]
    assert (dirty.status, dirty.recuts, dirty.confidence) == ("auto_fixed", 1, 0.95) and dirty.source_end == 6.0
    assert dirty.source_start == 1.88 and dirty.leading_leak is None and dirty.trailing_leak is None
    first = {r.clip_id: r for r in qa.verify(clips.withColumn("duration", F.col("source_end") - F.col("source_start")), source.select(F.lit("dirty").alias("clip_id"), "text", "start", "end").filter("end <= 6")).collect()}
    assert first["dirty"].leading_leak.label == "Hook 1" and first["dirty"].leading_leak.trim_ms == round(dirty.source_start * 1000)
    assert first["dirty"].confidence < 0.95 and first["clean"].leading_leak is None
    flagged = {r.clip_id: r.status for r in qa.run(clips, source, max_recuts=0).collect()}
    assert flagged == {"dirty": "flagged", "clean": "clean"}
    moved = {r.clip_id: r for r in qa.nudge(qa.run(clips, source), spark.createDataFrame([("clean", 100.0, 0.0), ("dirty", 9000.0, 0.0)], "clip_id string, start_ms double, end_ms double"), source).collect()}
    assert moved["clean"].source_start == 20.1 and moved["clean"].status == "auto_fixed" and moved["dirty"].source_start == dirty.source_start  # a move that leaves nothing is refused
    r = qa.report(spark.createDataFrame([("s", "clean"), ("s", "flagged")], "source_id string, status string")).first()
    assert (r.clean, r.auto_fixed, r.flagged) == (1, 0, 1)
    done = qa.run(clips, source)
    assert qa.pushable(done.withColumn("status", F.lit("flagged")), clips.filter("clip_id = 'clean'")).count() == 1
