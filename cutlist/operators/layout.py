"""Safe zones of platforms: audits and placements of rectangles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlist.functions.text import round_half_up

#: Canvas, and the dead zones of each platform (top, bottom, left, right) in pixels.
WIDTH, HEIGHT = 1080, 1920
DEAD_ZONES = {"tiktok": (108, 320, 60, 120), "reels": (210, 310, 0, 84), "shorts": (120, 300, 0, 96), "universal": (210, 320, 60, 120)}
#: Elements that are placed.
ELEMENTS = ("full_frame", "hook_text", "upper_third", "middle", "lower_third", "caption", "progress_bar", "logo", "comment_overlay")


def platforms(spark: SparkSession) -> DataFrame:
    """platform, sx, sy, sw, sh: the safe rectangle of each platform; four rows."""
    rows = [F.struct(F.lit(n).alias("platform"), *[F.lit(float(v)).alias(k) for k, v in zip(("sx", "sy", "sw", "sh"), (le, t, WIDTH - le - r, HEIGHT - t - b), strict=True)]) for n, (t, b, le, r) in DEAD_ZONES.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def safe_zone_audit(rects: DataFrame, zones: DataFrame) -> DataFrame:
    """``rects`` (platform, x, y, width, height) with inside, the rectangle moved and shrunk into the zone, and caption margins."""
    both = rects.join(F.broadcast(zones), "platform")  # four rows
    right, bottom = F.col("sx") + F.col("sw"), F.col("sy") + F.col("sh")
    inside = (F.col("x") >= F.col("sx")) & (F.col("y") >= F.col("sy")) & (F.col("x") + F.col("width") <= right) & (F.col("y") + F.col("height") <= bottom)
    cx, cy = F.greatest("sx", F.least(F.col("x"), right)), F.greatest("sy", F.least(F.col("y"), bottom))
    out = both.withColumn("inside", inside).withColumn("cx", cx).withColumn("cy", cy)
    out = out.withColumn("cw", F.least("width", right - F.col("cx"))).withColumn("ch", F.least("height", bottom - F.col("cy")))
    out = out.withColumn("margin_l", F.col("cx")).withColumn("margin_r", WIDTH - (F.col("cx") + F.col("cw"))).withColumn("margin_v", HEIGHT - (F.col("cy") + F.col("ch")))
    return out.drop("sx", "sy", "sw", "sh")


def element_placement(zones: DataFrame) -> DataFrame:
    """platform, element, x, y, width, height: where each element goes inside each safe zone."""
    rows = zones.withColumn("element", F.explode(F.array(*[F.lit(e) for e in ELEMENTS])))
    e, sx, sy, sw, sh = (F.col(c) for c in ("element", "sx", "sy", "sw", "sh"))
    share = F.when(e.isin("hook_text", "caption"), 0.22).when(e == "middle", 0.40)
    height = F.when(e == "full_frame", sh).when(e.isin("upper_third", "lower_third"), round_half_up(sh / 3)).when(e == "progress_bar", 8.0).when(e == "logo", 120.0).when(e == "comment_overlay", 140.0)
    height = F.coalesce(height, round_half_up(sh * share)).cast("double")
    width = F.when(e == "logo", 120.0).when(e == "comment_overlay", round_half_up(sw * 0.72)).otherwise(sw).cast("double")
    rows = rows.withColumn("height", height).withColumn("width", width)
    h = F.col("height")
    y = F.when(e.isin("middle", "comment_overlay"), sy + round_half_up((sh - h) / 2)).when(e.isin("lower_third", "caption", "progress_bar"), sy + sh - h).otherwise(sy)
    x = F.when(e == "logo", sx + sw - F.col("width")).otherwise(sx)
    return rows.select("platform", "element", x.alias("x"), y.cast("double").alias("y"), "width", "height")
