"""Clips of projects: checks, sources, imports and keyed changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlist.functions.text import finite, is_blank

#: Media files by suffix.
SUFFIXES = ("mp4", "mov", "avi", "mkv", "webm", "mts", "m4v")


def supported_media(files: DataFrame) -> DataFrame:
    """``files`` (name) with ``supported`` and, for the rest, ``reason``."""
    ok = F.coalesce(F.lower("name").rlike(rf"\.(?:{'|'.join(SUFFIXES)})$"), F.lit(False))
    return files.withColumn("supported", ok).withColumn("reason", F.when(~ok, F.concat(F.coalesce("name", F.lit("")), F.lit(" is not a supported video"))))


def known_issues(clips: DataFrame) -> DataFrame:
    """One row for each clip with an issue: missing first, then a blank path, then a duration that is no positive number."""
    bad_path, bad_time = is_blank(F.col("path")), ~finite(F.col("duration")) | (F.col("duration") <= 0)
    kind = F.when(F.coalesce("missing", F.lit(False)), "missing").when(bad_path | bad_time, "invalid")
    detail = F.when(F.coalesce("missing", F.lit(False)), "source is missing").when(bad_path, "path is blank").when(bad_time, "duration is no positive number")
    return clips.withColumn("kind", kind).withColumn("detail", detail).filter("kind is not null")


def missing_sources(clips: DataFrame, inventory: DataFrame, overlays: DataFrame | None = None) -> DataFrame:
    """Distinct paths of clips, and of overlays if given, that the inventory lacks, with the number of clips (and of overlay slots) that use each."""
    used = clips.select("path", F.lit(1).alias("c"), F.lit(0).alias("o"))
    if overlays is not None:
        used = used.unionByName(overlays.filter(~is_blank(F.col("path"))).select("path", F.lit(0).alias("c"), F.lit(1).alias("o")))
    counts = [F.sum("c").cast("long").alias("n_clips"), *([F.sum("o").cast("long").alias("n_overlays")] if overlays is not None else [])]
    return used.groupBy("path").agg(*counts).join(inventory.select("path").distinct(), "path", "left_anti")


def missing_counts(clips: DataFrame, overlays: DataFrame, gone: DataFrame) -> DataFrame:
    """project_id, clips, overlays, total: how many clips and overlay slots (project_id, slot, path) of each project use a missing path; all projects have a row."""
    rows = clips.select("project_id", "path", F.lit("clip").alias("kind")).unionByName(overlays.select("project_id", "path", F.lit("overlay").alias("kind")))
    marked = rows.join(gone.select("path").distinct().withColumn("gone", F.lit(True)), "path", "left")
    n = [F.count_if(F.col("gone") & (F.col("kind") == k)).alias(f"{k}s") for k in ("clip", "overlay")]
    return marked.groupBy("project_id").agg(*n).withColumn("total", F.col("clips") + F.col("overlays"))


def mark_missing(clips: DataFrame, inventory: DataFrame) -> DataFrame:
    """``clips`` with ``missing`` set where the inventory lacks the path."""
    there = inventory.select("path").distinct().withColumn("there", F.lit(True))
    return clips.join(there, "path", "left").withColumn("missing", F.coalesce("missing", F.lit(False)) | F.col("there").isNull()).drop("there")


def preflight(clips: DataFrame, inventory: DataFrame) -> DataFrame:
    """project_id, clip_id, kind: known issues; for projects without any, clips whose source is gone."""
    known = known_issues(clips).select("project_id", "clip_id", "kind")
    clean = clips.join(known.select("project_id").distinct(), "project_id", "left_anti")
    gone = clean.join(inventory.select("path").distinct(), "path", "left_anti").select("project_id", "clip_id", F.lit("missing").alias("kind"))
    return known.unionByName(gone)


def import_outcome(imports: DataFrame) -> DataFrame:
    """``imports`` with ``kind``: what became of each import row.

    Columns: cancelled, metadata_ok, trim_wanted, path, trimmed_path, trimmed
    (seconds). A trim counts if its path is not blank, its seconds are a number
    from 0 on, and are 0 or the path has changed.
    """
    seconds = F.col("trimmed")
    valid = ~is_blank(F.col("trimmed_path")) & finite(seconds) & (seconds >= 0) & ((seconds == 0) | (F.col("trimmed_path") != F.col("path")))
    kind = (
        F.when(F.col("cancelled"), "cancelled")
        .when(~F.col("metadata_ok"), "metadata-failure")
        .when(~F.col("trim_wanted"), "added-original")
        .when(F.coalesce(valid, F.lit(False)), "trim-success")
        .otherwise("trim-fallback")
    )
    return imports.withColumn("kind", kind)


def import_summary(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Six counters for each batch, how many were added, and the tone of the message."""

    def n(condition) -> F.Column:
        return F.count_if(condition)

    kind = F.col("kind")
    counted = outcomes.groupBy(*keys).agg(
        n((kind == "trim-success") & (F.col("trimmed") > 0)).alias("trimmed_n"),
        n((kind == "trim-success") & ~(F.col("trimmed") > 0)).alias("no_silence_n"),
        n(kind == "trim-fallback").alias("untrimmed_n"),
        n(kind == "added-original").alias("original_n"),
        n(kind == "metadata-failure").alias("rejected_n"),
        n(kind == "cancelled").alias("cancelled_n"),
    )
    added = F.expr("trimmed_n + no_silence_n + untrimmed_n + original_n")
    tone = F.when((added == 0) & (F.col("rejected_n") > 0), "error").when(F.expr("untrimmed_n + rejected_n + cancelled_n > 0"), "warning").otherwise("success")
    return counted.withColumn("added_n", added).withColumn("tone", tone)


def hook_text_requests(clips: DataFrame, hook_texts: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Hook clips without a text: their transcript, or why they are skipped."""
    hooks = clips.filter("bucket = 'hook'").join(hook_texts.select("clip_id", "hook_text"), "clip_id", "left").filter(is_blank(F.col("hook_text")))
    text = hooks.join(transcripts.select("path", "full_text"), "path", "left")
    return text.select("project_id", "clip_id", "full_text", F.when(is_blank(F.col("full_text")), "no transcript").alias("skipped"))


def add(base: DataFrame, new: DataFrame) -> DataFrame:
    """Append ``new`` clips to their buckets; places go on after the last."""
    last = base.groupBy("project_id", "bucket").agg(F.max("ord").alias("last"))
    moved = new.join(last, ["project_id", "bucket"], "left").withColumn("ord", (F.col("ord") + F.coalesce(F.col("last") + 1, F.lit(0))).cast("int")).drop("last")
    return base.unionByName(moved.select(base.columns))


def remove(base: DataFrame, keys: DataFrame) -> DataFrame:
    return base.join(keys.select("bucket", "clip_id").distinct(), ["bucket", "clip_id"], "left_anti").select(base.columns)


def upsert(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the last update (by ``seq``) of each key: its non-null columns replace those of the base."""
    columns = [c for c in updates.columns if c not in (*keys, "seq")]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*columns), "seq").alias("u"))
    out = base.join(last, keys, "left")
    return out.select(*[F.coalesce(F.col(f"u.{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def dependency_paths(clips: DataFrame, overlays: DataFrame) -> DataFrame:
    """Distinct paths that projects depend on."""
    return clips.select("path").union(overlays.select("path")).filter(~is_blank(F.col("path"))).distinct()
