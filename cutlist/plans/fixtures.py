"""Inputs of the registered queries, derived from the driver's tables by SQL.

Each has one text for Spark and one for DuckDB; where one text is given it is
the same for both. Table names stand in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "part events lineitem embeddings documents orders".split()

#: Cue phrases written over the words, by turn and place.
_CUES = "(0,0,'hook'),(0,1,'one'),(1,0,'Meat'),(1,1,'2'),(2,0,'C'),(2,1,'T.'),(2,2,'A'),(2,3,'1'),(3,0,'cta2'),(4,0,'call'),(4,1,'to'),(4,2,'action'),(4,3,'three'),(5,0,'hook,'),(5,1,'one'),(6,0,'body'),(6,1,'4'),(7,0,'see'),(7,1,'tea'),(7,2,'a'),(7,3,'two')"


def _words(base: str, end: str) -> str:
    return f"""select source_id, idx, text, (end_ms - dur)/1000.0e0 start, end_ms/1000.0e0 {end} from (
 select source_id, idx, text, dur, sum(dur + gap) over (partition by source_id order by idx rows between unbounded preceding and current row) end_ms from (
 select b.source_id, b.idx, coalesce(q.w,b.tok) text, 80+40*least(length(coalesce(q.w,b.tok)),12) dur,
 case when b.idx % 97 = 0 then 700 when b.idx % 211 = 5 then 4000 else 30 end gap
 from ({base}) b left join (values {_CUES}) as q(k,f,w) on b.idx % 97 = q.f and cast(floor(b.idx/97) as bigint) % 8 = q.k) z) y"""


SQL: dict[str, tuple[str, str] | str] = {
    "clips": """select cast(floor(p_partkey/12) as bigint) project_id,
 case p_partkey % 3 when 0 then 'hook' when 1 then 'meat' else 'cta' end bucket,
 cast(floor((p_partkey % 12)/3) as int) ord, concat('c',cast(p_partkey as varchar(20))) clip_id,
 concat('/clips/',cast(p_partkey as varchar(20)),'.mp4') path, concat(p_name,'.v',cast(p_partkey % 7 as varchar(20)),'.mp4') name,
 case when p_size % 10 = 0 then 0.0e0 else p_size/4.0e0 end duration, p_partkey % 50 = 7 missing from {part}""",
    "hook_texts": """select concat('c',cast(p_partkey as varchar(20))) clip_id, case when p_partkey % 2 = 0 then p_name else '  ' end hook_text from {part} where p_partkey % 3 = 0""",
    "inventory": "select concat('/clips/',cast(p_partkey as varchar(20)),'.mp4') path, p_size*1000 size, p_partkey*1000 mtime_ms from {part} where p_partkey % 13 <> 0",
    "cache": """select concat('/clips/',cast(p_partkey as varchar(20)),'.mp4') path, case when p_partkey % 4 = 0 then 'tiny' else 'base' end model, p_size*1000 size,
 case when p_partkey % 5 = 0 then p_partkey*1000-1 else p_partkey*1000 end mtime_ms from {part} where p_partkey % 3 <> 2""",
    "render_events": """select cast(floor(user_id/10) as bigint) batch_id, user_id job_id, event_id seq, ts,
 case event_type when 'error' then 'error' when 'click' then 'overlaying' when 'view' then 'rendering' when 'signup' then 'queued' else 'done' end status,
 least(100.0e0, value) pct, event_id % 9 = 0 force_emit, event_id % 4 run_id from {events}""",
    "stderr_lines": """select event_id, case event_id % 6 when 0 then 'av_interleaved: No Space Left On Device' when 1 then 'clip.mp4: No such file or directory'
 when 2 then 'moov atom not found' when 3 then 'Decoder (codec hevc) not found for input stream' when 4 then 'Invalid data found when processing input' else concat('unrecognised ',event_type,case cast(floor(event_id/6) as bigint) % 5 when 0 then ': OpenEncodeSessionEx failed (10)' when 1 then ': No capable devices found' when 2 then ' Cannot load nvcuda.dll' when 3 then ': out of memory' else '' end) end raw from {events}""",
    "silence_lines": """select user_id source_id, event_id line_no, case event_id % 3 when 0 then concat('[silencedetect @ 0x] silence_start: ',cast(event_id % 400 as varchar(20)),'.25')
 when 1 then concat('silence_end: ',cast(event_id % 400 as varchar(20)),'.5 | silence_duration: 0.25') else 'frame= 100 fps=30' end line from {events}""",
    "rects": """select l_orderkey*10+l_linenumber rect_id, case l_linenumber % 4 when 0 then 'tiktok' when 1 then 'reels' when 2 then 'shorts' else 'universal' end platform,
 cast(l_quantity*20 as double) x, cast(l_partkey % 1900 as double) y, cast(l_suppkey % 900 as double) width, cast(l_quantity*6 as double) height from {lineitem}""",
    "vad_frames": (
        "select vec_id source_id, i frame, abs(cast(x as double))*1.5e0 prob from (select vec_id, posexplode(embedding) as (i,x) from {embeddings})",
        "select vec_id source_id, generate_subscripts(embedding,1)-1 frame, abs(cast(unnest(embedding) as double))*1.5e0 prob from {embeddings}",
    ),
    "words": (
        _words("select doc_id source_id, idx, tok from (select doc_id, posexplode(filter(split(text,'[ \\\\n\\\\t\\\\r]+'), x -> x <> '')) as (idx,tok) from {documents})", "`end`"),
        _words(r"select doc_id source_id, generate_subscripts(t,1)-1 idx, unnest(t) tok from (select doc_id, list_filter(regexp_split_to_array(text,'[ \n\t\r]+'), lambda x: x <> '') t from {documents})", '"end"'),
    ),
    "probe": """select concat('/clips/',cast(p_partkey as varchar(20)),'.mp4') path, p_size/4.0e0 duration, 1080 width, case when p_size % 5 = 0 then 1280 else 1920 end height,
 case when p_size % 3 = 0 then 25.0e0 else 30.0e0 end fps, 'h264' codec, 'aac' audio_codec from {part}""",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = SQL[name] if isinstance(SQL[name], str) else SQL[name][0]
    for t in TABLES:
        text = text.replace("{" + t + "}", f"parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(text)


def cte(*names: str) -> str:
    """``WITH`` clause that defines the named inputs in DuckDB."""
    parts = []
    for name in names:
        text = SQL[name] if isinstance(SQL[name], str) else SQL[name][1]
        parts.append(f"{name} as ({re.sub(r'{(%s)}' % '|'.join(TABLES), r'\1', text)})")
    return "with " + ",\n".join(parts) + "\n"
