"""Permutations of hook, meat and call-to-action clips inside each project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutlist.functions.text import output_name

ROLES = ("hook", "meat", "cta")


def total(clips: DataFrame) -> DataFrame:
    """project_id, total: how many combos a project has, counted without making them."""
    counts = clips.groupBy("project_id").agg(*[F.count_if(F.col("bucket") == r).alias(r) for r in ROLES])
    return counts.select("project_id", F.expr("hook * meat * cta").alias("total"))


def plan(clips: DataFrame, limit: int | None = None) -> DataFrame:
    """project_id, combo_idx, combo_id and the three clip ids, hook first; at most ``limit`` for each project.

    A combo's number follows from its clips' dense places, so the limit cuts
    hooks and meats before they are joined. Only ids and places are joined.
    """
    place = W.partitionBy("project_id", "bucket").orderBy("ord", "clip_id")
    dense = clips.select("project_id", "bucket", "clip_id", (F.row_number().over(place) - 1).cast("long").alias("k"))
    sizes = clips.groupBy("project_id").agg(F.count_if(F.col("bucket") == "meat").alias("m_n"), F.count_if(F.col("bucket") == "cta").alias("c_n"))
    hook, meat, cta = (dense.filter(F.col("bucket") == r).select("project_id", F.col("clip_id").alias(f"{r}_id"), F.col("k").alias(r[0])) for r in ROLES)
    hook = hook.join(sizes, "project_id")
    if limit is not None:
        hook = hook.filter(F.col("h") * F.col("m_n") * F.col("c_n") < limit)
    pair = hook.join(meat, "project_id").withColumn("hm", F.col("h") * F.col("m_n") + F.col("m"))
    if limit is not None:
        pair = pair.filter(F.col("hm") * F.col("c_n") < limit)
    full = pair.join(cta, "project_id").withColumn("combo_idx", F.col("hm") * F.col("c_n") + F.col("c"))
    if limit is not None:
        full = full.filter(F.col("combo_idx") < limit)
    combo = F.concat_ws("__", "hook_id", "meat_id", "cta_id")
    return full.select("project_id", "combo_idx", combo.alias("combo_id"), "hook_id", "meat_id", "cta_id")


def with_clips(combos: DataFrame, clips: DataFrame, *columns: str) -> DataFrame:
    """``combos`` with the named columns of their three clips, prefixed by role."""
    for r in ROLES:
        side = clips.select("project_id", F.col("clip_id").alias(f"{r}_id"), *[F.col(c).alias(f"{r}_{c}") for c in columns])
        combos = combos.join(side, ["project_id", f"{r}_id"])
    return combos


def named(combos: DataFrame, clips: DataFrame, hook_texts: DataFrame) -> DataFrame:
    """``combos`` with names and paths of their clips, the hook's text and ``output_name``."""
    full = with_clips(combos, clips, "name", "path", "duration")
    full = full.join(hook_texts.select(F.col("clip_id").alias("hook_id"), "hook_text"), "hook_id", "left")
    return full.withColumn("output_name", output_name(F.col("hook_text"), F.col("hook_name"), F.col("meat_name"), F.col("cta_name"), F.col("combo_idx")))


def unpivoted(combos: DataFrame) -> DataFrame:
    """project_id, combo_id, combo_idx, seg, clip_id: three rows for each combo."""
    each = F.array(*[F.struct(F.lit(i).alias("seg"), F.col(f"{r}_id").alias("clip_id")) for i, r in enumerate(ROLES)])
    return combos.select("project_id", "combo_id", "combo_idx", F.inline(each))


def required_clips(combos: DataFrame, clips: DataFrame) -> DataFrame:
    """Distinct paths that the combos need: for each the clip that is used first."""
    uses = unpivoted(combos).join(clips.select("project_id", "clip_id", "path", "name"), ["project_id", "clip_id"])
    first = uses.groupBy("project_id", "path").agg(F.min(F.struct("combo_idx", "seg", "clip_id", "name")).alias("f"))
    return first.select("project_id", "path", "f.clip_id", "f.name")


def affected(combos: DataFrame, clips: DataFrame, failed_paths: DataFrame) -> DataFrame:
    """Combos that use a failed path in any role."""
    bad = clips.join(failed_paths.select("path").distinct(), "path", "left_semi").select("project_id", "clip_id")
    hit = unpivoted(combos).join(bad, ["project_id", "clip_id"], "left_semi").select("project_id", "combo_id").distinct()
    return combos.join(hit, ["project_id", "combo_id"], "left_semi")


def approval_matches(current: DataFrame, approved: DataFrame) -> DataFrame:
    """project_id, matches: whether both tables (project_id, item) hold the same items as often."""
    a = current.groupBy("project_id", "item").agg(F.count("*").alias("n"))
    b = approved.groupBy("project_id", "item").agg(F.count("*").alias("m"))
    both = a.join(b, ["project_id", "item"], "full")
    return both.groupBy("project_id").agg(F.bool_and(F.coalesce(F.col("n") == F.col("m"), F.lit(False))).alias("matches"))
