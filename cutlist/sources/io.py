"""Reading and writing: projects, inventories, probes, logs, transcripts, captions and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .shared import shuffles_removed

#: Names of the twelve fields of a caption style, here and in project files.
STYLE = {
    "font_name": "fontName", "font_file": "fontFile", "font_size": "fontSize", "primary_color": "primaryColor", "highlight_color": "highlightColor", "outline_color": "outlineColor",
    "back_color": "backColor", "outline": "outline", "shadow": "shadow", "border_style": "borderStyle", "words_per_line": "wordsPerLine", "animation": "animation",
}
_NUMBERS = ("font_size", "outline", "shadow", "border_style", "words_per_line")
_STYLE = ",".join(f"{c}:{'double' if n in _NUMBERS else 'string'}" for n, c in STYLE.items())
_POINT = "struct<x:double,y:double>"
_CLIP = "struct<id:string,path:string,name:string,duration:double,thumbnail:string,missing:boolean>"
PROJECT = (
    f"id string, version int, hooks array<{_CLIP}>, meats array<{_CLIP}>, ctas array<{_CLIP}>, hookTexts map<string,string>, "
    "targetPlatform string, autoTrimSilence boolean, captionOffsetMs double, "
    "mediaOverlays struct<meat:string,cta:string>, settings struct<resolution:struct<width:int,height:int,label:string>,outputDirectory:string>, "
    f"captionStyle struct<{_STYLE}>, templateLayout map<string,{_POINT}>, _corrupt_record string"
)
BUCKETS = {"hook": "hooks", "meat": "meats", "cta": "ctas"}


def read_projects(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """Tables ``projects``, ``clips``, ``hook_texts`` and ``overlays`` of project files, one JSON each, or one in each line.

    Fields that are absent get their defaults; a file that can't be parsed is a
    project with ``corrupt`` set and nothing else.
    """
    raw = spark.read.schema(PROJECT).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)
    raw = raw.withColumn("file", F.input_file_name()).withColumn("project_id", F.coalesce("id", F.sha1(F.col("file").cast("binary"))))
    projects = raw.select(
        "project_id",
        "file",
        F.col("_corrupt_record").isNotNull().alias("corrupt"),
        F.coalesce("targetPlatform", F.lit("universal")).alias("target_platform"),
        F.coalesce("autoTrimSilence", F.lit(False)).alias("auto_trim_silence"),
        F.coalesce("captionOffsetMs", F.lit(0.0)).alias("caption_offset_ms"),
        F.coalesce("settings.resolution.width", F.lit(1080)).alias("width"),
        F.coalesce("settings.resolution.height", F.lit(1920)).alias("height"),
        F.col("settings.outputDirectory").alias("output_directory"),
        F.struct(*[F.col(f"captionStyle.{c}").alias(n) for n, c in STYLE.items()]).alias("caption_style"),
        F.coalesce("templateLayout", F.create_map().cast(f"map<string,{_POINT}>")).alias("template_layout"),
    )
    parts = [raw.select("project_id", F.lit(b).alias("bucket"), F.posexplode(c).alias("ord", "c")) for b, c in BUCKETS.items()]
    clips = parts[0].unionByName(parts[1]).unionByName(parts[2])
    clips = clips.select("project_id", "bucket", "ord", F.col("c.id").alias("clip_id"), "c.path", "c.name", "c.duration", "c.thumbnail", F.coalesce("c.missing", F.lit(False)).alias("missing"))
    texts = raw.select("project_id", F.explode("hookTexts").alias("clip_id", "hook_text"))
    overlays = raw.select("project_id", F.inline(F.array(*[F.struct(F.lit(s).alias("slot"), F.col(f"mediaOverlays.{s}").alias("path")) for s in ("meat", "cta")])))
    return {"projects": projects, "clips": clips, "hook_texts": texts, "overlays": overlays.filter("path is not null")}


def nested_projects(projects: DataFrame, clips: DataFrame, hook_texts: DataFrame, overlays: DataFrame | None = None) -> DataFrame:
    """project_id, json: the tables nested into one document of version 1 for each project.

    Of ``projects`` the first four columns are needed; width, height,
    output_directory, caption_style and template_layout are written if there, as
    are ``thumbnail`` of clips and ``overlays``.
    """
    more = [c for c in ("width", "height", "output_directory", "caption_style", "template_layout") if c in projects.columns]
    out = projects.select("project_id", "target_platform", "auto_trim_silence", "caption_offset_ms", *more)
    for bucket, column in BUCKETS.items():
        item = F.struct("ord", F.col("clip_id").alias("id"), "path", "name", "duration", *[c for c in ("thumbnail",) if c in clips.columns], "missing")
        of = clips.filter(F.col("bucket") == bucket).groupBy("project_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
        of = of.select("project_id", F.transform("items", lambda c: c.dropFields("ord")).alias(column))
        out = out.join(of, "project_id", "left").withColumn(column, F.coalesce(column, F.from_json(F.lit("[]"), of.schema[column].dataType)))
    texts = hook_texts.groupBy("project_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("clip_id", "hook_text")))).alias("hookTexts"))
    out = out.join(texts, "project_id", "left")
    extra = []
    if overlays is not None:
        slots = overlays.groupBy("project_id").agg(F.struct(*[F.max(F.when(F.col("slot") == s, F.col("path"))).alias(s) for s in ("meat", "cta")]).alias("mediaOverlays"))
        out = out.join(slots, "project_id", "left")
        extra.append(F.col("mediaOverlays"))
    if "width" in more and "height" in more:
        directory = F.col("output_directory") if "output_directory" in more else F.lit(None).cast("string")
        extra.append(F.struct(F.struct("width", "height").alias("resolution"), directory.alias("outputDirectory")).alias("settings"))
    if "caption_style" in more:
        extra.append(F.struct(*[F.col(f"caption_style.{n}").alias(c) for n, c in STYLE.items()]).alias("captionStyle"))
    if "template_layout" in more:
        extra.append(F.col("template_layout").alias("templateLayout"))
    body = F.struct(
        F.col("project_id").alias("id"),
        F.lit(1).alias("version"),
        *BUCKETS.values(),
        F.coalesce("hookTexts", F.create_map().cast("map<string,string>")).alias("hookTexts"),
        F.col("target_platform").alias("targetPlatform"),
        F.col("auto_trim_silence").alias("autoTrimSilence"),
        F.col("caption_offset_ms").alias("captionOffsetMs"),
        *extra,
    )
    return out.select("project_id", F.to_json(body).alias("json"))


def write_projects(projects: DataFrame, clips: DataFrame, hook_texts: DataFrame, path: str, overlays: DataFrame | None = None) -> None:
    """Project documents as lines of text files, many to a file; ``read_projects`` takes them with ``lines``."""
    nested_projects(projects, clips, hook_texts, overlays).select("json").write.text(path)


def media_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size, mtime_ms of files; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").cast("double").alias("mtime_ms")).distinct()


_STREAM = "array<struct<codec_type:string,codec_name:string,width:int,height:int,r_frame_rate:string,avg_frame_rate:string>>"


def parse_probe_json(df: DataFrame) -> DataFrame:
    """``df`` (json) with duration, width, height, codec, fps, audio_codec of the first streams, or ``error``."""
    doc = F.from_json("json", f"streams {_STREAM}, format struct<duration:string>")

    def first(kind: str) -> F.Column:
        return F.try_element_at(F.filter("doc.streams", lambda s: s["codec_type"] == kind), F.lit(1))

    out = df.withColumn("doc", doc).withColumn("v", first("video")).withColumn("a", first("audio"))
    rate = F.coalesce(F.nullif("v.r_frame_rate", F.lit("")), F.nullif("v.avg_frame_rate", F.lit("")), F.lit(""))
    parts = F.split(rate, "/")
    top, under = parts[0].try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    fps = F.when(F.size(parts) == 2, F.when(under > 0, top / under).otherwise(0.0)).otherwise(F.coalesce(top, F.lit(0.0)))
    ok = F.col("v").isNotNull()
    return out.select(
        *df.columns,
        F.when(ok, F.coalesce(F.col("doc.format.duration").try_cast("double"), F.lit(0.0))).alias("duration"),
        F.when(ok, F.coalesce("v.width", F.lit(0))).alias("width"),
        F.when(ok, F.coalesce("v.height", F.lit(0))).alias("height"),
        F.when(ok, F.coalesce("v.codec_name", F.lit("unknown"))).alias("codec"),
        F.when(ok, fps).alias("fps"),
        F.when(ok, F.coalesce("a.codec_name", F.lit("unknown"))).alias("audio_codec"),
        F.when(~ok, "no video stream").alias("error"),
    )


def parse_silence_log(df: DataFrame) -> DataFrame:
    """``df`` (line) with silence_start and silence_end; null where the line has none or a negative one."""

    def value(name: str) -> F.Column:
        return F.nullif(F.regexp_extract("line", rf"{name}:\s*([\d.]+)", 1), F.lit("")).try_cast("double")

    return df.withColumn("silence_start", value("silence_start")).withColumn("silence_end", value("silence_end"))


def transcript_key(path: F.Column, model: F.Column) -> F.Column:
    """SHA-1 of path, a zero byte, and the model or nothing."""
    return F.sha1(F.concat(path, F.char(F.lit(0)), F.coalesce(model, F.lit(""))).cast("binary"))


def write_transcripts(words: DataFrame, path: str) -> None:
    """Store rows (path, model, idx, text, start, end) by a key prefix: words, or speech intervals with ``text`` left empty in a store of their own."""
    keyed = words.withColumn("key", transcript_key(F.col("path"), F.col("model"))).withColumn("prefix", F.substring("key", 1, 2))
    with shuffles_removed(words.sparkSession):
        keyed.repartition("prefix").sortWithinPartitions("key", "idx").write.partitionBy("prefix").mode("append").parquet(path)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Stored words without rows that break the schema: they count as absent."""
    rows = spark.read.parquet(path).drop("prefix")
    return rows.filter(F.col("text").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull() & ~F.isnan("start") & ~F.isnan("end"))


def transcript_entries(words: DataFrame, speech: DataFrame | None = None) -> DataFrame:
    """key, path, model, words, full and speech_intervals: one entry for each stored transcript of words (path, model, idx, text, start, end) and speech (path, model, start, end)."""
    said = F.array_sort(F.collect_list(F.struct("idx", "text", "start", "end")))
    out = words.groupBy("path", "model").agg(F.transform(said, lambda w: w.dropFields("idx")).alias("words"))
    out = out.withColumn("full", F.trim(F.array_join(F.transform("words", lambda w: w["text"]), " ")))
    if speech is not None:
        heard = speech.groupBy(F.col("path").alias("_path"), F.col("model").alias("_model")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("speech_intervals"))
        out = out.join(heard, (F.col("path") == F.col("_path")) & F.col("model").eqNullSafe(F.col("_model")), "left").drop("_path", "_model")
    return out.withColumn("key", transcript_key(F.col("path"), F.col("model")))


def write_captions(documents: DataFrame, path: str) -> None:
    """Caption documents (job_id, ass), many to a file and sorted by job, so that one is found by its file's statistics; a folder for each job would make millions of tiny files."""
    documents.select("job_id", "ass").repartitionByRange("job_id").sortWithinPartitions("job_id").write.parquet(path)


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("job_id string, ass string").parquet(path)


def _manifests(inputs: DataFrame) -> DataFrame:
    """job_id, manifest, rejected and bad_segs, the places of paths with line breaks."""
    escaped = F.replace(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), F.lit("'"), F.lit("'\\''"))
    line = F.concat(F.lit("file '"), escaped, F.lit("'"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seg", line.alias("line")))), lambda x: x["line"])
    bad = F.array_sort(F.collect_list(F.when(F.col("path").rlike(r"[\r\n]"), F.col("seg"))))
    out = inputs.groupBy("job_id").agg(F.array_join(lines, "\n").alias("manifest"), bad.alias("bad_segs")).withColumn("rejected", F.size("bad_segs") > 0)
    return out.select("job_id", F.when(~F.col("rejected"), F.col("manifest")).alias("manifest"), "rejected", "bad_segs")


def render_manifest(inputs: DataFrame) -> DataFrame:
    """job_id, manifest, rejected: a concat list for each job from rows of job_id, seg, path; line breaks in a path reject the job."""
    return _manifests(inputs).drop("bad_segs")


def write_manifests(inputs: DataFrame, path: str) -> dict[str, int]:
    """Write manifests and rejected jobs to folders of their own under ``path`` in one pass; returns how many of each were written."""
    counts = Observation()
    made = _manifests(inputs).observe(counts, F.count_if(~F.col("rejected")).alias("manifests"), F.count_if("rejected").alias("rejected"))
    made.write.partitionBy("rejected").parquet(path)
    return {k: int(v or 0) for k, v in counts.get.items()}


def read_manifests(spark: SparkSession, path: str, rejected: bool = False) -> DataFrame:
    """job_id and manifest of what ``write_manifests`` wrote, or job_id and bad_segs of the rejected jobs."""
    rows = spark.read.schema("job_id string, manifest string, bad_segs array<int>, rejected boolean").parquet(path).filter(F.col("rejected") == rejected)
    return rows.select("job_id", "bad_segs") if rejected else rows.select("job_id", "manifest")
