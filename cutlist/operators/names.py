"""Free names for segment files and batch folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutlist.functions.text import safe_segment


def _stem(name: str, number: str, first: str, other: str):
    k = F.col(number)
    return F.when(k == 1, F.concat(F.col(name), F.lit(first))).otherwise(F.concat(F.col(name), F.lit(other.split("#")[0]), k.cast("string"), F.lit(other.split("#")[1] + first)))


def segment_files(segments: DataFrame, existing: DataFrame) -> DataFrame:
    """``segments`` (source_id, rank, label) with ``file``: the k-th use of a name takes its k-th free number.

    ``existing`` (source_id, file) holds names that are taken. A name is never
    used more than its uses plus what is taken, so that many numbers are enough.
    """
    named = segments.withColumn("name", safe_segment(F.col("label"), "clip"))
    use = named.withColumn("use", F.row_number().over(W.partitionBy("source_id", "name").orderBy("rank")))
    uses = named.groupBy("source_id", "name").agg(F.count("*").alias("n"))
    taken = existing.groupBy("source_id").agg(F.count("*").alias("m"))
    slots = uses.join(taken, "source_id", "left").withColumn("k", F.explode(F.sequence(F.lit(1), (F.col("n") + F.coalesce("m", F.lit(0))).cast("int"))))
    slots = slots.withColumn("file", _stem("name", "k", ".mp4", "_#")).join(existing.select("source_id", "file"), ["source_id", "file"], "left_anti")
    free = slots.withColumn("use", F.row_number().over(W.partitionBy("source_id", "name").orderBy("k"))).select("source_id", "name", "use", "file")
    return use.join(free, ["source_id", "name", "use"]).drop("name", "use")


def batch_directories(batches: DataFrame, prefix: str) -> DataFrame:
    """``batches`` (batch_id, ts) with ``directory``: prefix and time, with a number in brackets from the second on."""
    base = F.concat(F.lit(prefix + " "), F.date_format("ts", "yyyy-MM-dd HH-mm-ss"))
    rows = batches.withColumn("base", base).withColumn("k", F.row_number().over(W.partitionBy("base").orderBy("batch_id")))
    return rows.withColumn("directory", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" ("), F.col("k").cast("string"), F.lit(")")))).drop("base", "k")
