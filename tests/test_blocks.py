"""Forms that cut one long key into blocks, against walks over the whole."""

import random

from pyspark.sql import functions as F

from cutlist.operators import progress, speech, words
from cutlist.sources import io


def walked(rows, every):
    """seqs sent of (batch, seq, micros, force)."""
    last, sent = {}, []
    for batch, seq, t, force in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if force or batch not in last or t - last[batch] >= every * 1000:
            last[batch] = t
            sent.append((batch, seq))
    return sorted(sent)


def test_throttle_over_blocks(spark):
    rng = random.Random(3)
    rows = []

    def add(batch, times, forced=0.0):
        rows.extend((batch, len(rows) + k, t, rng.random() < forced or (None if k % 3 else False)) for k, t in enumerate(times))

    add("grid", range(0, 12_000_000, 50_000))  # never meets: each block depends on all before
    add("odd", [7_000 + 30_000 * k for k in range(500)], 0.01)
    add("ties", [100_000 * (k // 5) for k in range(1500)], 0.05)
    add("random", [rng.randrange(40_000_000) for _ in range(3000)], 0.02)
    add("sparse", [rng.randrange(10**13) for _ in range(500)])
    add("edge", [-1, 0, 199_999, 200_000, 399_999, 400_000, 799_999, 800_000, 999_999])
    add("forced", [1_000 * k for k in range(300)], 1.0)
    ev = spark.createDataFrame(rows, "batch_id string, seq long, t long, force_emit boolean").select("batch_id", "seq", F.timestamp_micros("t").alias("ts"), "force_emit")
    odd = spark.createDataFrame([(None, -1, 0, True), ("grid", -2, None, True)], "batch_id string, seq long, t long, force_emit boolean")
    ev = ev.unionByName(odd.select("batch_id", "seq", F.timestamp_micros("t").alias("ts"), "force_emit"))
    for every, block in ((200, 2), (200, 50)):
        got = progress.throttle(ev, every, block)
        assert got.schema == ev.schema
        assert sorted((r.batch_id, r.seq) for r in got.collect()) == walked(rows, every), (every, block)
    assert progress.throttle(ev.limit(0)).count() == 0


def test_speech_over_blocks(spark):
    rng = random.Random(4)
    rows = []
    for source, n in (("a", 400), ("quiet", 90), ("loud", 90), ("one", 1), ("holes", 300)):
        for f in range(n):
            if source != "holes" or rng.random() < 0.6 and not 100 < f < 160:
                rows.append((source, f, {"quiet": 0.05, "loud": 0.9}.get(source, rng.choice([0.0, 0.2, 0.2, 0.2, 0.2, 0.5]))))
    want, state = [], {}
    for source, f, p in rows:
        start, before = state.get(source, (None, None))
        if start is None and p > speech.ENTER:
            start = f
        elif start is not None and p < speech.LEAVE:
            want.append((source, start, before + 1))
            start = None
        state[source] = (start, f)
    want += [(s, start, f + 1) for s, (start, f) in state.items() if start is not None]
    frames = spark.createDataFrame(rows, "source_id string, frame long, prob double")
    for block in (7, speech.BLOCK):
        got = [(r.source_id, round(r.start / speech.FRAME), round(r.end / speech.FRAME)) for r in speech.vad_intervals(frames, block).collect()]
        assert sorted(got) == sorted(want), block


def test_long_run_of_one_word(spark):
    n = 60_000
    run = spark.range(n).select(F.lit("s").alias("source_id"), F.lit("la").alias("text"), (F.col("id") * 0.3).alias("start"), (F.col("id") * 0.3 + F.when(F.col("id") % 3 == 0, 0.3).otherwise(0.2)).alias("end"))
    kept = []
    for i in range(n):
        start, end = i * 0.3, i * 0.3 + (0.3 if i % 3 == 0 else 0.2)
        if kept and start <= kept[-1][1] + words.TOUCH_AFTER and kept[-1][0] <= end + words.TOUCH_BEFORE:
            if end - start <= kept[-1][1] - kept[-1][0]:
                kept[-1] = (start, end)
        else:
            kept.append((start, end))
    got = words.dedupe_repeats(run).orderBy("idx").collect()
    assert [(r.idx, r.start, r.end) for r in got] == [(i, *k) for i, k in enumerate(kept)]


def test_manifests_and_rejects(spark, tmp_path):
    rows = spark.createDataFrame([("j", 1, "/b's.mp4"), ("j", 0, "c:\\a.mp4"), ("k", 0, "x\ny"), ("k", 1, "/z"), ("k", 2, "\r")], "job_id string, seg int, path string")
    assert io.write_manifests(rows, f"{tmp_path}/m") == {"manifests": 1, "rejected": 1}
    assert [tuple(r) for r in io.read_manifests(spark, f"{tmp_path}/m").collect()] == [("j", "file 'c:/a.mp4'\nfile '/b'\\''s.mp4'")]
    assert [tuple(r) for r in io.read_manifests(spark, f"{tmp_path}/m", rejected=True).collect()] == [("k", [0, 2])]
    assert io.write_manifests(rows.limit(0), f"{tmp_path}/none") == {"manifests": 0, "rejected": 0}
