"""Registered queries: each applies one operator to inputs derived from the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutlist.functions import text
from cutlist.operators import captions, clips, combos, errors, jobs, layout, markers, names, progress, qa, silence, speech, transcripts, words
from cutlist.sources import io
from cutlist.sources.shared import materialize

from . import walk
from .registry import query

_DENSE = """with d as (select project_id, bucket, clip_id, name, path, duration, row_number() over (partition by project_id, bucket order by ord, clip_id) - 1 as k from clips),
 s as (select project_id, count(*) filter (bucket = 'meat') mn, count(*) filter (bucket = 'cta') cn from clips group by 1),
 combos as (select h.project_id, cast((h.k * mn + m.k) * cn + c.k as bigint) combo_idx, h.clip_id || '__' || m.clip_id || '__' || c.clip_id combo_id,
  h.clip_id hook_id, m.clip_id meat_id, c.clip_id cta_id, h.name hn, m.name mname, c.name cname, h.path hp, m.path mp, c.path cp
  from d h join d m on m.project_id = h.project_id and m.bucket = 'meat' join d c on c.project_id = h.project_id and c.bucket = 'cta' join s on s.project_id = h.project_id where h.bucket = 'hook')"""
_LABEL = r"""case when trim(coalesce(hook_text, '')) = '' then regexp_replace(hn, '\.[^.]+$', '') else regexp_replace(regexp_replace(trim(hook_text), '[<>:"/\\|?*]+', '', 'g'), '\s+', ' ', 'g') end"""


@query(
    _DENSE + rf""" select combos.project_id, combo_idx, combo_id, {_LABEL} || '_' || regexp_replace(mname, '\.[^.]+$', '') || '_' || regexp_replace(cname, '\.[^.]+$', '') || '_' || (combo_idx + 1) || '.mp4' output_name
 from combos left join hook_texts t on t.clip_id = hook_id""",
    "clips",
    "hook_texts",
)
def combos_plan(clips_: DataFrame, hook_texts: DataFrame) -> DataFrame:
    return combos.named(combos.plan(clips_), clips_, hook_texts).select("project_id", "combo_idx", "combo_id", "output_name")


@query(_DENSE + " select project_id, combo_idx, combo_id from combos where combo_idx < 10", "clips")
def combos_limit(clips_: DataFrame) -> DataFrame:
    return combos.plan(clips_, limit=10).select("project_id", "combo_idx", "combo_id")


@query("select project_id, count(*) filter (bucket = 'hook') * count(*) filter (bucket = 'meat') * count(*) filter (bucket = 'cta') total from clips group by 1", "clips")
def combos_total(clips_: DataFrame) -> DataFrame:
    return combos.total(clips_)


@query(
    _DENSE + """, u as (select project_id, combo_idx, 0 seg, hook_id clip_id, hn name, hp path from combos union all select project_id, combo_idx, 1, meat_id, mname, mp from combos
 union all select project_id, combo_idx, 2, cta_id, cname, cp from combos)
 select project_id, path, clip_id, name from (select *, row_number() over (partition by project_id, path order by combo_idx, seg, clip_id) r from u) where r = 1""",
    "clips",
)
def combos_required_clips(clips_: DataFrame) -> DataFrame:
    return combos.required_clips(combos.plan(clips_), clips_)


@query(
    _DENSE + " select project_id, combo_idx, combo_id from combos where hp not in (select path from inventory) or mp not in (select path from inventory) or cp not in (select path from inventory)",
    "clips",
    "inventory",
)
def combos_affected(clips_: DataFrame, inventory: DataFrame) -> DataFrame:
    gone = clips.missing_sources(clips_, inventory)
    return combos.affected(combos.plan(clips_), clips_, gone).select("project_id", "combo_idx", "combo_id")


@query("select name, regexp_matches(lower(name), '\\.(mp4|mov|avi|mkv|webm|mts|m4v)$') supported from (select case when ord = 1 then replace(name, '.mp4', '.TXT') when ord = 2 then replace(name, '.mp4', '.MOV') else name end as name from clips)", "clips")
def clips_supported_media(clips_: DataFrame) -> DataFrame:
    renamed = F.when(F.col("ord") == 1, F.replace("name", F.lit(".mp4"), F.lit(".TXT"))).when(F.col("ord") == 2, F.replace("name", F.lit(".mp4"), F.lit(".MOV"))).otherwise(F.col("name"))
    return clips.supported_media(clips_.select(renamed.alias("name"))).select("name", "supported")


@query("select project_id, clip_id, case when missing then 'missing' else 'invalid' end kind from clips where missing or trim(path) = '' or duration is null or duration <= 0", "clips")
def clips_known_issues(clips_: DataFrame) -> DataFrame:
    return clips.known_issues(clips_).select("project_id", "clip_id", "kind")


@query("select path, count(*) n_clips from clips where path not in (select path from inventory) group by 1", "clips", "inventory")
def clips_missing_sources(clips_: DataFrame, inventory: DataFrame) -> DataFrame:
    return clips.missing_sources(clips_, inventory)


@query(
    """with k as (select project_id, clip_id, case when missing then 'missing' else 'invalid' end kind from clips where missing or duration <= 0)
 select * from k union all select project_id, clip_id, 'missing' from clips where project_id not in (select project_id from k) and path not in (select path from inventory)""",
    "clips",
    "inventory",
)
def clips_preflight(clips_: DataFrame, inventory: DataFrame) -> DataFrame:
    return clips.preflight(clips_, inventory)


@query(
    """with o as (select project_id, case when missing then 'cancelled' when duration = 0 then 'metadata-failure' when ord = 3 then 'added-original' when ord = 0 or trimmed = 0 then 'trim-success' else 'trim-fallback' end kind, trimmed
  from (select *, duration - floor(duration) trimmed from clips))
 select *, trimmed_n + no_silence_n + untrimmed_n + original_n added_n, case when trimmed_n + no_silence_n + untrimmed_n + original_n = 0 and rejected_n > 0 then 'error' when untrimmed_n + rejected_n + cancelled_n > 0 then 'warning' else 'success' end tone
 from (select project_id, count(*) filter (kind = 'trim-success' and trimmed > 0) trimmed_n, count(*) filter (kind = 'trim-success' and trimmed = 0) no_silence_n, count(*) filter (kind = 'trim-fallback') untrimmed_n,
  count(*) filter (kind = 'added-original') original_n, count(*) filter (kind = 'metadata-failure') rejected_n, count(*) filter (kind = 'cancelled') cancelled_n from o group by 1)""",
    "clips",
)
def clips_import_summary(clips_: DataFrame) -> DataFrame:
    seconds = F.col("duration") - F.floor("duration")
    moved = F.when(F.col("ord") == 0, F.concat("path", F.lit(".trim"))).otherwise(F.col("path"))
    imports = clips_.select("project_id", F.col("missing").alias("cancelled"), (F.col("duration") > 0).alias("metadata_ok"), (F.col("ord") != 3).alias("trim_wanted"), "path", moved.alias("trimmed_path"), seconds.alias("trimmed"))
    return clips.import_summary(clips.import_outcome(imports), "project_id")


@query(
    "select distinct path from (select path from clips union all select concat('/clips/', clip_id, '.png') from hook_texts)",
    "clips",
    "hook_texts",
)
def clips_dependency_paths(clips_: DataFrame, hook_texts: DataFrame) -> DataFrame:
    return clips.dependency_paths(clips_, hook_texts.select(F.concat(F.lit("/clips/"), "clip_id", F.lit(".png")).alias("path")))


@query(
    """select c.project_id, c.bucket, c.clip_id, u.path, coalesce(u.duration, c.duration) duration from clips c
 left join (select clip_id, '/moved/' || clip_id path, case when ord = 0 then null else duration + 1 end duration from clips) u using (clip_id)""",
    "clips",
)
def clips_relink(clips_: DataFrame) -> DataFrame:
    first = clips_.select("clip_id", F.lit(1).alias("seq"), F.lit("/old").alias("path"), F.lit(9.0).alias("duration"))
    last = clips_.select("clip_id", F.lit(2).alias("seq"), F.concat(F.lit("/moved/"), "clip_id").alias("path"), F.when(F.col("ord") != 0, F.col("duration") + 1).alias("duration"))
    return clips.upsert(clips_, first.unionByName(last), ["clip_id"]).select("project_id", "bucket", "clip_id", "path", "duration")


@query("select project_id, bucket, clip_id, ord from clips where not missing union all select project_id, bucket, clip_id || 'n', last + 1 from (select *, max(ord) over (partition by project_id, bucket) as last from clips where not missing) where ord = 0", "clips")
def clips_add_remove(clips_: DataFrame) -> DataFrame:
    kept = clips.remove(clips_, clips_.filter("missing"))
    # the new clips' places go on after those of their bucket
    return clips.add(kept, kept.filter("ord = 0").withColumn("clip_id", F.concat("clip_id", F.lit("n")))).select("project_id", "bucket", "clip_id", "ord")


_GAPS = """with g as (select source_id, coalesce(lag("end") over (partition by source_id order by start, "end"), 0.0) gap_start, start gap_end from words union all
  select source_id, arg_max("end", start), max("end") + 5.0 from words group by 1), gaps as (select * from g where gap_end - gap_start > 3.0)"""


@query(_GAPS + " select * from gaps", "words")
def words_find_gaps(w: DataFrame) -> DataFrame:
    return words.find_gaps(w, _durations(w))


def _durations(w: DataFrame) -> DataFrame:
    return w.groupBy("source_id").agg((F.max("end") + 5.0).alias("duration"))


@query(
    _GAPS + """ select source_id, gap_start + k * 12.0 seg_start, least(gap_start + k * 12.0 + 12.0, gap_end) seg_end from gaps, lateral (select unnest(generate_series(0, cast(ceil((gap_end - gap_start) / 12.0) as bigint) - 1)) k)
 where least(gap_start + k * 12.0 + 12.0, gap_end) - (gap_start + k * 12.0) >= 0.5""",
    "words",
)
def words_gap_segments(w: DataFrame) -> DataFrame:
    return words.gap_segments(words.find_gaps(w, _durations(w)))


@query("select source_id, trim(string_agg(text, ' ' order by idx)) full_text from words group by 1", "words")
def words_full_text(w: DataFrame) -> DataFrame:
    return words.full_text(w)


@query(
    """with s as (select source_id, k seg_id, k * 20.0 seg_start, k * 20.0 + 12.0 seg_end from (select source_id, unnest(generate_series(0, cast(floor(max("end") / 20.0) as bigint))) k from words group by 1))
 select source_id, seg_id, idx, text, greatest(0.0, start - seg_start) start, least("end" - seg_start, seg_end - seg_start) "end" from words join s using (source_id) where "end" > seg_start and start < seg_end""",
    "words",
)
def words_in_segments(w: DataFrame) -> DataFrame:
    w = materialize(w)  # read twice
    return words.in_segments(w, _windows(w))


def _windows(w: DataFrame) -> DataFrame:
    last = w.groupBy("source_id").agg(F.floor(F.max("end") / 20.0).alias("n"))
    each = last.select("source_id", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("seg_id"))
    return each.select("source_id", "seg_id", (F.col("seg_id") * 20.0).alias("seg_start"), (F.col("seg_id") * 20.0 + 12.0).alias("seg_end"))


@query("""select source_id, count(*) filter (not ("end" > 5.0 and start < 30.0)) dropped from words group by 1""", "words")
def words_dropped_by_trim(w: DataFrame) -> DataFrame:
    trims = w.select("source_id").distinct().select("source_id", F.lit(5.0).alias("trim_start"), F.lit(30.0).alias("trim_end"))
    return words.dropped_by_trim(w, trims)


@query(
    r"""select source_id, idx, trim(substring(regexp_replace(case when idx % 7 = 0 then '{' || text || '}' || chr(10) else text end, '[{}]', '', 'g'), 1, 200).replace(chr(10), '\N')) text, start, "end" from words where idx % 11 <> 0""",
    "words",
)
def words_sanitize(w: DataFrame) -> DataFrame:
    odd = F.when(F.col("idx") % 7 == 0, F.concat(F.lit("{"), "text", F.lit("}\n"))).otherwise(F.col("text"))
    rows = w.select("source_id", "idx", odd.alias("text"), F.when(F.col("idx") % 11 == 0, float("nan")).otherwise(F.col("start")).alias("start"), "end")
    return words.sanitize(rows)


_VAD = """with s as (select *, case when prob > 0.3 then 1 when prob < 0.1 then 0 end sw from vad_frames),
 o as (select source_id, frame, coalesce(last_value(sw ignore nulls) over (partition by source_id order by frame), 0) v from s),
 r as (select *, frame - row_number() over (partition by source_id, v order by frame) g from o),
 iv as (select source_id, min(frame) * 0.032 "start", (max(frame) + 1) * 0.032 "end" from (select source_id, cast(frame as double) frame, g from r where v = 1) group by source_id, g)"""
_MERGED = _VAD + """, t as (select *, sum(case when "start" - pe >= 0.4 then 1 else 0 end) over (partition by source_id order by "start") seq from (select *, lag("end") over (partition by source_id order by "start") pe from iv)),
 speech as (select source_id, cast(seq as int) seq, min("start") "start", max("end") "end" from t group by 1, 2)"""


@query(_VAD + " select * from iv", "vad_frames")
def speech_vad_intervals(frames: DataFrame) -> DataFrame:
    return speech.vad_intervals(frames)


@query(_MERGED + " select * from speech", "vad_frames")
def speech_merge_close(frames: DataFrame) -> DataFrame:
    return speech.merge_close(speech.vad_intervals(frames))


def _points(frames: DataFrame) -> DataFrame:
    return frames.select("source_id", (F.col("frame") * 0.04).alias("t"))


_NEAR = ", p as (select source_id, cast(frame as double) * 0.04 t from vad_frames), n as (select p.source_id, t, (select min(\"start\") from iv where iv.source_id = p.source_id and \"start\" >= t) ns, (select max(\"end\") from iv where iv.source_id = p.source_id and \"start\" < t) pe from p)"


@query(
    _VAD + _NEAR + " select source_id, t, case when ns is not null then greatest(coalesce(pe, 0.0), t) when t >= pe then t end gap_start, case when ns is not null then ns when t >= pe then cast('inf' as double) end gap_end from n",
    "vad_frames",
)
def speech_silence_at(frames: DataFrame) -> DataFrame:
    return speech.silence_at(_points(frames), speech.vad_intervals(frames))


@query(_VAD + _NEAR + " select source_id, t, ns is null or t - coalesce(pe, 0.0) >= 0.3 quiet from n", "vad_frames")
def speech_has_lead_silence(frames: DataFrame) -> DataFrame:
    return speech.has_lead_silence(_points(frames), speech.vad_intervals(frames))


_BOUNDS = r"""with l as (select source_id, line_no, try_cast(nullif(regexp_extract(line, 'silence_start:\s*([\d.]+)', 1), '') as double) s, try_cast(nullif(regexp_extract(line, 'silence_end:\s*([\d.]+)', 1), '') as double) e from silence_lines),
 a as (select source_id, arg_min(s, line_no) filter (s is not null) fs, min(line_no) filter (s is not null) fsn, arg_min(e, line_no) filter (e is not null) fe, min(line_no) filter (e is not null) fen,
  arg_max(s, line_no) filter (s is not null) last_start, arg_max(e, line_no) filter (e is not null) last_end from l group by 1),
 b as (select source_id, case when fsn <= fen and fs < 0.01 then fe else 0.0 end leading_end, last_start, last_end from a)"""


@query(_BOUNDS + " select * from b", "silence_lines")
def silence_bounds(lines: DataFrame) -> DataFrame:
    return silence.bounds(lines)


@query(
    _BOUNDS
    + """, c as (select *, case when leading_end >= 0.1 then greatest(0.0, leading_end - 0.05) else 0.0 end x, case when last_start is not null and (last_end is null or last_start > last_end or d - last_end < 0.05) then least(d, last_start + 0.05) else d end y from (select *, (select count(*) * 7.5e0 + 120 from silence_lines where silence_lines.source_id = b.source_id) d from b))
 select source_id, cast(case when x + (d - y) < 0.1 or y - x < 0.2 then 0.0 else x end as double) trim_start, cast(case when x + (d - y) < 0.1 or y - x < 0.2 then d else y end as double) trim_end, cast(case when x + (d - y) < 0.1 or y - x < 0.2 then 0.0 else x + (d - y) end as double) trimmed from c""",
    "silence_lines",
)
def silence_trim_plan(lines: DataFrame) -> DataFrame:
    return silence.trim_plan(silence.bounds(lines), lines.groupBy("source_id").agg((F.count("*") * 7.5 + 120).alias("duration")))


_ZONES = "with z(platform, sx, sy, sw, sh) as (values ('tiktok', 60.0, 108.0, 900.0, 1492.0), ('reels', 0.0, 210.0, 996.0, 1400.0), ('shorts', 0.0, 120.0, 984.0, 1500.0), ('universal', 60.0, 210.0, 900.0, 1390.0))"


@query(
    _ZONES
    + """, c as (select r.*, x >= sx and y >= sy and x + width <= sx + sw and y + height <= sy + sh inside, cast(greatest(sx, least(x, sx + sw)) as double) cx, cast(greatest(sy, least(y, sy + sh)) as double) cy, sx + sw rr, sy + sh bb from rects r join z using (platform)),
 e as (select *, cast(least(width, rr - cx) as double) cw, cast(least(height, bb - cy) as double) ch from c)
 select platform, rect_id, x, y, width, height, inside, cx, cy, cw, ch, cx margin_l, 1080 - (cx + cw) margin_r, 1920 - (cy + ch) margin_v from e""",
    "rects",
)
def layout_safe_zone_audit(rects: DataFrame) -> DataFrame:
    return layout.safe_zone_audit(rects, layout.platforms(rects.sparkSession))


@query(
    "select event_id, case event_id % 6 when 0 then 'disk_full' when 1 then 'missing_file' when 2 then 'damaged' when 3 then 'codec' when 4 then 'invalid_data' else 'generic' end code, event_id % 6 = 5 and cast(floor(event_id/6) as bigint) % 5 < 4 gpu from stderr_lines",
    "stderr_lines",
)
def errors_classify(lines: DataFrame) -> DataFrame:
    return lines.select("event_id", errors.code(F.col("raw")).alias("code"), errors.is_gpu_session(F.col("raw")).alias("gpu"))


_LATEST = "with l as (select batch_id, job_id, max(seq) seq, arg_max(status, seq) status, arg_max(pct, seq) pct from render_events group by 1, 2)"


@query(_LATEST + " select * from l", "render_events")
def progress_latest(events: DataFrame) -> DataFrame:
    return progress.latest(events)


@query(
    _LATEST + " select batch_id, count(*) filter (status = 'done') done, count(*) filter (status = 'error') error, count(*) filter (status = 'canceled') canceled, count(*) total, cast(floor(sum(pct) / count(*) + 0.5) as bigint) percent from l group by 1",
    "render_events",
)
def progress_overall(events: DataFrame) -> DataFrame:
    return progress.overall(progress.latest(events))


@query(
    _LATEST
    + """ select batch_id, case when count(*) filter (status = 'canceled') > 0 then 'canceled' when count(*) filter (status = 'error') = 0 then 'success' else 'errors' end verdict, arg_min('/out/' || job_id, job_id) filter (status = 'done') first_output from l group by 1""",
    "render_events",
)
def progress_batch_outcome(events: DataFrame) -> DataFrame:
    jobs = events.select("job_id").distinct().select("job_id", F.col("job_id").alias("ord"), F.concat(F.lit("/out/"), F.col("job_id").cast("string")).alias("output_path"))
    return progress.batch_outcome(progress.latest(events), jobs)


@query("select batch_id, job_id, seq, run_id from (select *, max(run_id) over (partition by batch_id, job_id) m from render_events) where run_id = m", "render_events")
def progress_drop_superseded(events: DataFrame) -> DataFrame:
    return progress.drop_superseded(events, "batch_id", "job_id").select("batch_id", "job_id", "seq", "run_id")


@query(
    """select seq, case when status in ('done', 'error') then status when status in ('rendering', 'overlaying') then 'rendering' else 'queued' end cell,
 cast(case when seq % 2 = 0 then floor(greatest(0.0, least(100.0, pct)) * 0.2 + 0.5) else floor(20 + greatest(0.0, least(100.0, pct)) * 0.8 + 0.5) end as bigint) phase_pct from render_events""",
    "render_events",
)
def progress_cells(events: DataFrame) -> DataFrame:
    phase = F.when(F.col("seq") % 2 == 0, "concat").otherwise("overlay")
    return events.select("seq", progress.cell_status(F.col("status")).alias("cell"), progress.phase_percent(phase, F.col("pct")).alias("phase_pct"))


@query(
    """select rect_id, cast(floor(ms / 3600000) as bigint) || ':' || lpad(cast(cast(floor(ms % 3600000 / 60000) as bigint) as varchar), 2, '0') || ':' || lpad(cast(cast(floor(ms % 60000 / 1000) as bigint) as varchar), 2, '0') || '.' || lpad(cast(cast(floor(ms % 1000 / 10) as bigint) as varchar), 2, '0') stamp
 from (select rect_id, x * y * 10 ms from rects)""",
    "rects",
)
def fn_ass_timestamp(rects: DataFrame) -> DataFrame:
    return rects.select("rect_id", text.ass_timestamp(F.col("x") * F.col("y") * 10).alias("stamp"))


@query(r"select source_id, idx, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') token from words", "words")
def fn_normalize_token(w: DataFrame) -> DataFrame:
    return w.select("source_id", "idx", text.normalize_token(F.col("text")).alias("token"))


@query(
    r"select clip_id, string_split(path, '/')[-1] file, regexp_replace(regexp_replace(name, '[^a-zA-Z0-9._-]', '_', 'g'), '^\.+', '') segment, '/out/' || name joined from clips",
    "clips",
)
def fn_paths(clips_: DataFrame) -> DataFrame:
    return clips_.select("clip_id", text.file_name(F.col("path")).alias("file"), text.safe_segment(F.col("name"), "clip").alias("segment"), text.join_output_path(F.lit("/out//"), F.col("name")).alias("joined"))


@query("with " + walk.tokens("words") + " select token, bucket, cast(num as int) num from v_t left join v_bucket using (token) left join v_num using (token) where bucket is not null or num is not null", "words")
def markers_vocabulary(w: DataFrame) -> DataFrame:
    return markers.vocabulary(w).filter("bucket is not null or num is not null").select("token", "bucket", "num")


@query(
    "with recursive durations as (select source_id, max(\"end\") + 5.0e0 duration from words group by 1), "
    + walk.tokens("words")
    + ",\n"
    + walk.detected("m", "words", "durations")
    + " select source_id, cast(row_number() over (partition by source_id order by idx) - 1 as int) as rank, label, bucket, start_time, end_time, cast(idx as int) cue_first, cast(idx + n - 1 as int) cue_last from m_t2",
    "words",
)
def markers_detect(w: DataFrame) -> DataFrame:
    w = materialize(w)  # read several times, as a stored table
    return markers.detect(w, _durations(w))


@query(
    """select path, case when s is null then 'unavailable' when c.model is null then 'absent' when c.model = 'base' and c.size = s and c.mtime_ms = m then 'hit' else 'stale' end state,
 not coalesce(c.model = 'base' and c.size = s and c.mtime_ms = m, false) pending from (select distinct path from clips) left join (select path, size s, mtime_ms m from inventory) using (path) left join cache c using (path)""",
    "clips",
    "cache",
    "inventory",
)
def transcripts_inspect_cache(clips_: DataFrame, cache: DataFrame, inventory: DataFrame) -> DataFrame:
    return transcripts.inspect_cache(clips_, "base", cache, inventory)


@query(
    """with st as (select path, case when s is null then 'unavailable' when c.model is null then 'absent' when c.model = 'base' and c.size = s and c.mtime_ms = m then 'hit' else 'stale' end state, s, m, k from (select path, max(cast(clip_id[2:] as bigint)) k from clips group by 1) left join (select path, size s, mtime_ms m from inventory) using (path) left join cache c using (path)),
 f as (select path, case when state = 'hit' then null when k % 17 = 0 then 'model' when state = 'unavailable' or k % 11 = 0 then 'source' when k % 7 = 0 then 'transcription' end failure, state from st)
 select path, case when failure is not null then 'failed' when state = 'hit' then 'cached' else 'transcribed' end outcome, failure from f""",
    "clips",
    "cache",
    "inventory",
)
def transcripts_prepare(clips_: DataFrame, cache: DataFrame, inventory: DataFrame) -> DataFrame:
    k = F.substring("clip_id", 2, 20).cast("long")
    attempts = clips_.groupBy("path").agg(F.max(k).alias("k")).select("path", "k", (F.col("k") % 17 != 0).alias("model_ok"), (F.col("k") % 7 != 0).alias("ok"))
    after = inventory.join(attempts.select("path", "k"), "path").select("path", "size", (F.col("mtime_ms") + F.when(F.col("k") % 11 == 0, 1).otherwise(0)).alias("mtime_ms"))
    return transcripts.prepare(transcripts.inspect_cache(clips_, "base", cache, inventory), attempts, inventory, after)


_JOBS = _DENSE + """, j as (select project_id, combo_idx, combo_id, hook_text, trim(coalesce(hook_text, '')) <> '' has, hd, md, hp, mp, cp from (select combos.*, h.duration hd, m.duration md from combos join clips h on h.clip_id = hook_id join clips m on m.clip_id = meat_id) left join hook_texts t on t.clip_id = hook_id)"""


def _jobs(clips_: DataFrame, hook_texts: DataFrame, **kind) -> DataFrame:
    return jobs.plan(combos.named(combos.plan(clips_), clips_, hook_texts), "b1", "/out", **kind)


@query(_JOBS + " select project_id, combo_id, case when has then trim(hook_text) end text_overlay, case when has then hd end hook_sec, case when has then 'slow' else 'fast' end route from j", "clips", "hook_texts")
def jobs_route(clips_: DataFrame, hook_texts: DataFrame) -> DataFrame:
    return jobs.route(_jobs(clips_, hook_texts, captions=False)).select("project_id", "combo_id", "text_overlay", "hook_sec", "route")


_SEGS = _JOBS + ", i as (select project_id, combo_id, 0 seg, 'hook' as role, hp path from j union all select project_id, combo_id, 1, 'meat', mp from j union all select project_id, combo_id, 2, 'cta', cp from j)"


@query(
    _SEGS + " select project_id, combo_id, seg, coalesce(sum(d) over (partition by combo_id order by seg rows between unbounded preceding and 1 preceding), 0.0) + 250.0 offset_ms, d duration_ms from (select i.*, duration * 1000 d from i join probe using (path))",
    "clips",
    "hook_texts",
    "probe",
)
def jobs_timeline(clips_: DataFrame, hook_texts: DataFrame, probe: DataFrame) -> DataFrame:
    plan = _jobs(clips_, hook_texts, captions=True)
    rows = jobs.timeline(plan, probe, 250.0).join(plan.select("job_id", "project_id", "combo_id"), "job_id")
    return rows.select("project_id", "combo_id", "seg", "offset_ms", "duration_ms")


@query(_SEGS + " select distinct path, path || '::1080x1920:true' cache_key from i join probe using (path) where not (width = 1080 and height = 1920 and abs(fps - 30) < 0.5 and codec = 'h264' and audio_codec = 'aac')", "clips", "hook_texts", "probe")
def jobs_needs_normalization(clips_: DataFrame, hook_texts: DataFrame, probe: DataFrame) -> DataFrame:
    return jobs.needs_normalization(jobs.inputs(_jobs(clips_, hook_texts, captions=False)), probe, 1080, 1920)


@query(_SEGS + " select combo_id, path from i where path not in (select path from cache)", "clips", "hook_texts", "cache")
def jobs_missing_transcripts(clips_: DataFrame, hook_texts: DataFrame, cache: DataFrame) -> DataFrame:
    plan = _jobs(clips_, hook_texts, captions=True)
    return jobs.missing_transcripts(plan, cache).join(plan.select("job_id", "combo_id"), "job_id").select("combo_id", "path")


@query(_SEGS + " select combo_id, arg_min('gone: ' || path, seg) error, string_agg(role, ', ' order by seg) failed_roles from i where path not in (select path from inventory) group by 1", "clips", "hook_texts", "inventory")
def jobs_isolate_failures(clips_: DataFrame, hook_texts: DataFrame, inventory: DataFrame) -> DataFrame:
    plan = _jobs(clips_, hook_texts, captions=False)
    gone = clips.missing_sources(clips_, inventory).select("path", F.concat(F.lit("gone: "), "path").alias("error"))
    return jobs.isolate_failures(plan, gone).join(plan.select("job_id", "combo_id"), "job_id").select("combo_id", "error", "failed_roles")


@query(
    _SEGS + r""" select combo_id, string_agg('file ''' || path || '''', chr(10) order by seg) manifest from i group by 1""",
    "clips",
    "hook_texts",
)
def io_render_manifest(clips_: DataFrame, hook_texts: DataFrame) -> DataFrame:
    plan = _jobs(clips_, hook_texts, captions=False)
    return io.render_manifest(jobs.inputs(plan)).join(plan.select("job_id", "combo_id"), "job_id").select("combo_id", "manifest")


@query(
    "select user_id batch_id, ts, 'cut ' || strftime(ts, '%Y-%m-%d %H-%M-%S') || case when k > 1 then ' (' || k || ')' else '' end directory from (select seq user_id, ts, row_number() over (partition by date_trunc('second', ts) order by seq) k from render_events)",
    "render_events",
)
def names_batch_directories(events: DataFrame) -> DataFrame:
    return names.batch_directories(events.select(F.col("seq").alias("batch_id"), "ts"), "cut")


@query(
    """with s as (select cast(floor(project_id / 4) as bigint) || bucket source_id, 'Hook ' || cast(ord as varchar) lab, row_number() over (partition by cast(floor(project_id / 4) as bigint), bucket order by clip_id) rnk from clips)
 select source_id, rnk as rank, 'Hook_' || split_part(lab, ' ', 2) || case when k = 1 then '' else '_' || cast(k as varchar) end || '.mp4' file from (select *, row_number() over (partition by source_id, lab order by rnk) + 1 k from s)""",
    "clips",
)
def names_segment_files(clips_: DataFrame) -> DataFrame:
    of = F.floor(F.col("project_id") / 4)  # four projects to a source, so that labels repeat
    rank = F.row_number().over(Window.partitionBy(of, "bucket").orderBy("clip_id")).cast("long")
    segments = clips_.select(F.concat(of.cast("string"), "bucket").alias("source_id"), rank.alias("rank"), F.concat(F.lit("Hook "), F.col("ord").cast("string")).alias("label"))
    taken = segments.select("source_id", F.concat(F.replace("label", F.lit(" "), F.lit("_")), F.lit(".mp4")).alias("file")).distinct()
    return names.segment_files(segments, taken).select("source_id", "rank", "file")


_CUT = """cut as (select source_id, source_id || '-' || k clip_id, ['hook', 'meat', 'cta'][k % 3 + 1] bucket, k * 20.0e0 source_start, k * 20.0e0 + 12.0e0 source_end from (select source_id, unnest(generate_series(0, cast(floor(max("end") / 20.0) as bigint))) k from words group by 1))"""


@query("with recursive " + _CUT + ", " + walk.run("cut") + " select source_id, clip_id, bucket, source_start, source_end, confidence, recuts, status from q_done", "words")
def qa_run(w: DataFrame) -> DataFrame:
    w = materialize(w)
    windows = _windows(w)
    bucket = F.element_at(F.array(F.lit("hook"), F.lit("meat"), F.lit("cta")), (F.col("seg_id") % 3 + 1).cast("int"))
    name = F.concat_ws("-", F.col("source_id").cast("string"), F.col("seg_id").cast("string"))
    cut = windows.select("source_id", name.alias("clip_id"), bucket.alias("bucket"), F.col("seg_start").alias("source_start"), F.col("seg_end").alias("source_end"))
    return qa.run(cut, w).select("source_id", "clip_id", "bucket", "source_start", "source_end", "confidence", "recuts", "status")


@query(
    """with j as (select clip_id, trim(hook_text) t from hook_texts where trim(hook_text) <> ''), g as (select clip_id, cast(floor(length(t) * (67 * 0.55) + 0.5) as bigint) + 2 * 40 box_w from j)
 select clip_id, box_w, cast(67 + 2 * 23 as bigint) box_h, cast(floor((1080 - box_w) / 2.0 + 0.5) as bigint) box_x, cast(230 as bigint) box_y, cast(540 as bigint) text_x, cast(287 as bigint) text_y from g""",
    "hook_texts",
)
def captions_title_overlay(hook_texts: DataFrame) -> DataFrame:
    spoken = hook_texts.filter("trim(hook_text) <> ''").select(
        "clip_id", F.trim("hook_text").alias("text_overlay"), F.lit(2.5).alias("hook_sec"), F.lit(1080).alias("width"), F.lit(1920).alias("height"), F.lit(None).cast("double").alias("position_x"), F.lit(None).cast("double").alias("position_y")
    )
    return captions.title_overlay(spoken).select("clip_id", "box_w", "box_h", "box_x", "box_y", "text_x", "text_y")
