"""Silence of sources: bounds from detector lines, and the trim that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlist.sources.io import parse_silence_log


def bounds(lines: DataFrame) -> DataFrame:
    """source_id, leading_end, last_start, last_end from rows of source_id, line_no, line.

    The first end counts as leading only if silence had started by then, within
    0.01 s of the source's beginning.
    """
    parsed = parse_silence_log(lines).withColumn("at", F.col("line_no"))
    s, e, n = F.col("silence_start"), F.col("silence_end"), F.col("at")
    b = parsed.groupBy("source_id").agg(
        F.min_by(s, F.when(s.isNotNull(), n)).alias("first_start"),
        F.min(F.when(s.isNotNull(), n)).alias("first_start_at"),
        F.min_by(e, F.when(e.isNotNull(), n)).alias("first_end"),
        F.min(F.when(e.isNotNull(), n)).alias("first_end_at"),
        F.max_by(s, F.when(s.isNotNull(), n)).alias("last_start"),
        F.max_by(e, F.when(e.isNotNull(), n)).alias("last_end"),
    )
    leading = (F.col("first_start_at") <= F.col("first_end_at")) & (F.col("first_start") < 0.01)
    return b.select("source_id", F.when(leading, F.col("first_end")).otherwise(0.0).alias("leading_end"), "last_start", "last_end")


def trim_plan(bounds_: DataFrame, durations: DataFrame, margin: float = 0.05) -> DataFrame:
    """source_id, trim_start, trim_end, trimmed: what to cut at both ends; nothing if it is under 0.1 s or leaves under 0.2 s."""
    rows = bounds_.join(durations.select("source_id", "duration"), "source_id")
    start = F.when(F.col("leading_end") >= 0.1, F.greatest(F.lit(0.0), F.col("leading_end") - margin)).otherwise(0.0)
    silent = F.col("last_end").isNull() | (F.col("last_start") > F.col("last_end")) | (F.col("duration") - F.col("last_end") < 0.05)
    end = F.when(F.col("last_start").isNotNull() & silent, F.least(F.col("duration"), F.col("last_start") + margin)).otherwise(F.col("duration"))
    rows = rows.withColumn("a", start).withColumn("b", end).withColumn("cut", F.col("a") + (F.col("duration") - F.col("b")))
    none = (F.col("cut") < 0.1) | (F.col("b") - F.col("a") < 0.2)
    return rows.select(
        "source_id",
        F.when(none, 0.0).otherwise(F.col("a")).alias("trim_start"),
        F.when(none, F.col("duration")).otherwise(F.col("b")).alias("trim_end"),
        F.when(none, 0.0).otherwise(F.col("cut")).alias("trimmed"),
    )
