"""Worked values of single operators, and every registered SQL against its query."""

import math

import pytest
from pyspark.sql import functions as F

from cutlist.functions import text
from cutlist.operators import captions, clips, combos, errors, jobs, layout, names, progress, speech, words
from cutlist.sources import io

NAN, INF = float("nan"), float("inf")


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(r,) for r in rows], f"x {kind}")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_scalars(spark):
    assert values(spark, text.ass_timestamp, [0.0, 61_239.0, 3_600_000.0, -5.0, NAN, INF], "double") == ["0:00:00.00", "0:01:01.23", "1:00:00.00", "0:00:00.00", "0:00:00.00", "0:00:00.00"]
    assert values(spark, text.parse_spoken_number, ["one", "2nd", "100", "0", "ix", "thre", "plain", "", "007"]) == [1, 2, None, None, 6, 3, None, None, 7]
    assert values(spark, text.ass_color, ["#112233", "#80112233"]) == ["&H00332211", "&H00221180"]
    assert values(spark, text.ass_back_color, ["#112233", "#80112233"]) == ["&H00332211", "&H80332211"]
    assert values(spark, text.file_name, ["/a/b.mp4", r"c:\d\e.mov", "/a/"]) == ["b.mp4", "e.mov", "Unknown"]
    assert values(spark, lambda c: text.safe_segment(c, "clip"), ["Hook 1", "..x", "", "é!"]) == ["Hook_1", "x", "clip", "__"]
    assert values(spark, text.parse_clock, ["1:02.5", "75", "1:2:3", "x"]) == [62.5, 75.0, None, None]
    assert values(spark, text.normalize_chunk_text, ["  “Hello, there!” ", "It's"]) == ["hello, there", "it's"]
    assert values(spark, text.round_half_up, [-2.5, 2.5, 2.4], "double") == [-2, 3, 2]


def test_words_and_speech(spark):
    w = spark.createDataFrame([("a", "Hi", 0.0, 0.5), ("a", "hi.", 0.55, 0.8), ("a", "you", 0.9, 1.0), ("a", "you", 4.5, 4.7), ("a", " ", 5.0, 5.1), ("a", "nan", NAN, 1.0)], "source_id string, text string, start double, end double")
    got = [(r.text, r.start) for r in words.normalize_chunks(w).orderBy("idx").collect()]
    assert got == [("hi.", 0.55), ("you", 0.9), ("you", 4.5)]
    s = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 4.0)], "source_id string, start double, end double")
    p = spark.createDataFrame([("a", t) for t in (0.5, 1.0, 2.5, 3.5, 4.5)] + [("b", 1.0)], "source_id string, t double")
    got = {(r.source_id, r.t): (r.gap_start, r.gap_end) for r in speech.silence_at(p, s).collect()}
    assert got == {("a", 0.5): (0.5, 1.0), ("a", 1.0): (1.0, 1.0), ("a", 2.5): (2.5, 3.0), ("a", 3.5): (None, None), ("a", 4.5): (4.5, INF), ("b", 1.0): (None, None)}


def test_combos_and_clips(spark):
    rows = [(1, b, k, f"{b}{k}", f"/{b}{k}.mp4", f"{b} {k}.mp4", 2.0, False) for b in ("hook", "meat", "cta") for k in range(2)] + [(2, "hook", 0, "x", "/x.mp4", "x.mp4", math.nan, False)]
    df = spark.createDataFrame(rows, "project_id long, bucket string, ord int, clip_id string, path string, name string, duration double, missing boolean")
    ids = [r.combo_id for r in combos.plan(df, 3).orderBy("combo_idx").collect()]
    assert ids == ["hook0__meat0__cta0", "hook0__meat0__cta1", "hook0__meat1__cta0"]
    assert combos.plan(df, 0).count() == 0 and {(r.project_id, r.total) for r in combos.total(df).collect()} == {(1, 8), (2, 0)}
    assert [(r.clip_id, r.kind) for r in clips.known_issues(df).collect()] == [("x", "invalid")]
    texts = spark.createDataFrame([("hook0", ' My: "best"  hook ')], "clip_id string, hook_text string")
    named = combos.named(combos.plan(df, 1), df, texts)
    assert named.first().output_name == "My best hook_meat 0_cta 0_1.mp4"
    job = jobs.plan(named, "b", "/out/", captions=True)
    assert job.first().output_path == "/out/My best hook_meat 0_cta 0_1.mp4" and jobs.route(job).first().route == "slow"
    there = spark.createDataFrame([("/hook0.mp4",), ("/meat0.mp4",)], "path string")
    assert [r.path for r in jobs.missing_transcripts(job, there).collect()] == ["/cta0.mp4"]


def test_captions(spark):
    style = spark.createDataFrame([("Bad\nName", "x.exe", 9.0, "#ff00ff", "red", None, "#80000000", NAN, 99.0, 2.4, 0.0, "spin", 1080, 1920, None)], "font_name string, font_file string, font_size double, primary_color string, highlight_color string, outline_color string, back_color string, outline double, shadow double, border_style double, words_per_line double, animation string, width int, height int, position_y double")
    r = captions.sanitize_style(style).first()
    assert (r.font_name, r.font_file, r.font_size, r.primary_color, r.highlight_color, r.outline, r.shadow, r.border_style, r.words_per_line, r.animation) == ("Inter", "Inter-Bold.ttf", 0.2, "#FF00FF", "#FFFF00", 3.0, 20.0, 2, 12, "karaoke-fill")
    timeline = spark.createDataFrame([("j", 0, "/a", 0.0, 1000.0), ("j", 1, "/b", 1000.0, 0.0)], "job_id string, seg int, path string, offset_ms double, duration_ms double")
    spoken = spark.createDataFrame([("/a", 0, "one", 0.0, 0.5), ("/a", 1, "two", 0.5, 1.5), ("/a", 2, "late", 1.0, 2.0), ("/b", 0, "{x}", 0.25, 0.5)], "path string, idx int, text string, start double, end double")
    ass = captions.build(timeline, spoken, captions.style_header(captions.sanitize_style(style))).first().ass
    assert ass.endswith("Dialogue: 0,0:00:00.00,0:00:01.00,Karaoke,,0,0,0,,{\\kf50}one {\\kf50}two\nDialogue: 0,0:00:01.25,0:00:01.50,Karaoke,,0,0,0,,{\\kf25}x\n")
    assert "Style: Karaoke,Inter,384,&H0000FFFF,&H00FF00FF,&H00000000,&H80000000,-1,0,0,0,100,100,0,0,2,3,20,2,10,10,672,1" in ass


def test_io(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"id": "p1", "version": 1, "hooks": [{"id": "h", "path": "/h", "name": "h.mp4", "duration": 1.5}], "hookTexts": {"h": "Hi"}}')
    (tmp_path / "q.json").write_text("{not json")
    t = io.read_projects(spark, str(tmp_path))
    assert sorted(r.corrupt for r in t["projects"].collect()) == [False, True]
    assert [(r.bucket, r.ord, r.clip_id, r.missing) for r in t["clips"].collect()] == [("hook", 0, "h", False)]
    json = io.nested_projects(t["projects"], t["clips"], t["hook_texts"]).filter("project_id = 'p1'").first().json
    assert '"hookTexts":{"h":"Hi"}' in json and '"version":1' in json and '"meats":[]' in json
    assert io.media_inventory(spark, str(tmp_path), "*.json").count() == 2
    probe = spark.createDataFrame([('{"streams":[{"codec_type":"video","codec_name":"h264","width":10,"height":20,"r_frame_rate":"30000/1001"}],"format":{"duration":"1.5"}}',), ('{"streams":[]}',)], "json string")
    a, b = io.parse_probe_json(probe).collect()
    assert (a.duration, a.width, a.codec, a.audio_codec, a.error) == (1.5, 10, "h264", "unknown", None) and a.fps == pytest.approx(29.97, abs=0.01) and b.error
    lines = spark.createDataFrame([("[x] silence_start: 1.5",), ("silence_start: -0.5",), ("silence_end: 2 | silence_duration: 1",)], "line string")
    assert [(r.silence_start, r.silence_end) for r in io.parse_silence_log(lines).collect()] == [(1.5, None), (None, None), (None, 2.0)]
    w = spark.createDataFrame([("/a", "base", 0, "hi", 0.0, 1.0), ("/a", "base", 1, None, 0.0, 1.0)], "path string, model string, idx int, text string, start double, end double")
    io.write_transcripts(w, f"{tmp_path}/t")
    assert io.read_transcripts(spark, f"{tmp_path}/t").count() == 1
    m = spark.createDataFrame([("j", 1, "/b's.mp4"), ("j", 0, "c:\\a.mp4"), ("k", 0, "x\ny")], "job_id string, seg int, path string")
    assert {r.job_id: r.manifest for r in io.render_manifest(m).collect()} == {"j": "file 'c:/a.mp4'\nfile '/b'\\''s.mp4'", "k": None}


def test_layout_errors_progress_names(spark):
    zones = layout.platforms(spark)
    place = {(r.platform, r.element): (r.x, r.y, r.width, r.height) for r in layout.element_placement(zones).collect()}
    assert place[("tiktok", "full_frame")] == (60, 108, 900, 1492) and place[("universal", "caption")] == (60, 210 + 1390 - 306, 900, 306)
    assert place[("reels", "comment_overlay")] == (0, 840, 717, 140) and place[("shorts", "logo")] == (864, 120, 120, 120)
    assert values(spark, errors.code, ["ENOSPC: x", "Permission denied", "weird", None]) == ["disk_full", "no_permission", "generic", "generic"]
    assert values(spark, lambda c: errors.classify(c, "Concat"), ["corrupt", "weird"])[0].startswith("Concat: ")
    assert values(spark, errors.is_gpu_session, ["xx out of memory", "OUT OF MEMORY"]) == [True, False]
    assert values(spark, lambda c: progress.phase_percent(F.lit("concat"), c), [50.0, NAN, 200.0], "double") == [10, 0, 20]
    assert values(spark, progress.cell_status, [None, "done", "canceled", "normalizing"]) == ["idle", "done", "queued", "rendering"]
    seg = spark.createDataFrame([("s", 0, "Hook 1"), ("s", 1, "Hook 1"), ("s", 2, "Hook 1")], "source_id string, rank int, label string")
    used = spark.createDataFrame([("s", "Hook_1_2.mp4")], "source_id string, file string")
    assert [r.file for r in names.segment_files(seg, used).orderBy("rank").collect()] == ["Hook_1.mp4", "Hook_1_3.mp4", "Hook_1_4.mp4"]


def test_throttle(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, k, t0 + dt.timedelta(milliseconds=m), f) for k, (m, f) in enumerate([(0, False), (100, False), (150, True), (300, False), (350, False), (360, False)])]
    ev = spark.createDataFrame(rows, "batch_id long, seq long, ts timestamp, force_emit boolean")
    assert sorted(r.seq for r in progress.throttle(ev).collect()) == [0, 2, 4]


def test_every_sql_matches(spark):
    import os
    from collections import Counter

    import duckdb

    from cutlist.plans import further, registry as queries  # noqa: F401

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in os.listdir(sf):
        db.execute(f"create view {t.removesuffix('.parquet')} as select * from '{sf}/{t}'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, sf)
        found = db.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(got.columns), name
        assert Counter(map(repr, found.fetchall())) == Counter(repr(tuple(r)) for r in got.select(*[f"`{c}`" for c in columns]).collect()), name


def test_simple_captions_and_title(spark):
    c = spark.createDataFrame([("j", 0, " {hi}\nyou ", 0.0, 1500.0), ("j", 1, "x", 5.0, 5.0), ("j", 2, "", 6.0, 7.0)], "job_id string, idx int, text string, start double, end double")
    assert captions.simple(c).first().lines == "Dialogue: 0,0:00:00.00,0:00:01.50,Default,,0,0,0,,hi\\Nyou"
    j = spark.createDataFrame([("Hello", 2.0, 1080, 1920, 50.0, 10.0), (None, 2.0, 1080, 1920, None, None)], "text_overlay string, hook_sec double, width int, height int, position_x double, position_y double")
    (r,) = captions.title_overlay(j).collect()
    assert (r.font_size, r.box_w, r.box_h, r.box_x, r.box_y) == (67, 264, 113, 408, 192)
    assert r.box_line.startswith("Dialogue: 0,0:00:00.00,0:00:02.00,TextBox,,0,0,0,,{\\pos(408,192)\\p1}m 33 0 l 231 0 b 264 0 264 0 264 33 l 264 80 ")
    assert r.text_line.endswith("{\\pos(540,249)}Hello")
