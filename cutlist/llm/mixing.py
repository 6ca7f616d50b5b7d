"""Mixing sources to target weights by repetition rates.

Words are summed per source; each source gets a target; its rate is target over
size. A document is emitted floor(rate) times, and once more when a number in
[0, 1) hashed from its id and a seed is below the fraction of the rate.

Defined results: null text and empty text have size 0; null sources form one
source, the last; a source without words has target 0 and rate 0; rows that
repeat an id are drawn alike, rows without an id by their text; texts of any
length count whole; an empty table gives an empty table; no document is taken
more than twice. Other
columns of the input pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, materialize, words, wrapped

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
#: For each source the draw is made with the seed, of so many, whose words come nearest to the target: sources of few or long documents would else miss it by a tenth.
SEEDS = 16


def _draw(seed):
    """A number in [0, 1) from the document's key and ``seed``: the first 52 bits of their MD5."""
    key = F.concat(seed.cast("string"), F.lit(":"), F.col("key"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, rows, target for a table of source and size.

    Sources are dealt to tasks by range and numbered in each, after those of the
    tasks before, so no single task holds all of them. The limit is applied round by round: only
    three sums come to the driver in each.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("rows"))
    by = F.col("source").asc_nulls_last()
    ranged = materialize(per.repartitionByRange(by).withColumn("part", F.spark_partition_id()))
    counts = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one for each task
    before, done = [], 0
    for part in sorted(counts):
        before += [F.lit(part), F.lit(done)]
        done += counts[part]
    start = F.create_map(*before)[F.col("part")] if before else F.lit(0)
    k = start + F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (k % len(WEIGHTS) + 1).cast("int"))
    ranked = materialize(ranged.select("source", "source_size", "rows", weight.alias("weight")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    fixed = (-1, 0.0)  # sources at the limit, and the level that put them there
    while True:
        at = F.col("weight") * fixed[1] > LIMIT * F.col("source_size")
        n, full, free = ranked.agg(F.count_if(at), F.sum(F.when(at, F.col("source_size"))), F.sum(F.when(~at, F.col("weight")))).first()
        if n == fixed[0] or not free:
            break
        level = (SHARE * total - LIMIT * (full or 0)) / free
        fixed = (n, level)
    target = F.least(F.col("weight") * level, LIMIT * F.col("source_size").cast("double"))
    return ranked.select("source", "source_size", "rows", target.alias("target"))


def rates(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, rate, seed and rows (their number) for rows of key, source and size."""
    plan = materialize(targets(sizes).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    drawn = joined(sizes, plan)
    fraction = F.col("rate") - F.floor("rate")
    extra = [F.sum(F.when(_draw(F.lit(s)) < fraction, F.col("size")).otherwise(0)).alias(f"s{s}") for s in range(SEEDS)]
    sums = drawn.groupBy("source").agg(F.first("target").alias("t"), F.first("rate").alias("r"), F.first("source_size").alias("z"), F.count("*").alias("rows"), *extra)
    near = F.array_sort(F.array(*[F.struct(F.abs(F.floor("r") * F.col("z") + F.col(f"s{s}") - F.col("t")).alias("off"), F.lit(s).alias("seed")) for s in range(SEEDS)]))
    return sums.select("source", F.col("z").alias("source_size"), F.col("t").alias("target"), F.col("r").alias("rate"), near[0]["seed"].alias("seed"), "rows")


def joined(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with their source's plan, on one source that holds most rows as on many."""
    return join_counted(rows, plan, {"source": "source"}, "rows", plan.agg(F.sum("rows")).first()[0] or 0, by=("key",))


def copies():
    """How often a row with columns key, rate and seed is emitted."""
    return (F.floor("rate") + (_draw(F.col("seed")) < F.col("rate") - F.floor("rate")).cast("long")).cast("long")


def key() -> Column:
    """What a document is drawn by: its id, or its text if it has none."""
    return F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def measured(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", key().alias("key"), "source", F.size(words(F.col("text"))).cast("long").alias("size"))


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (size times copies), one row for each row of ``docs``."""
    sizes = materialize(measured(docs))
    out = joined(sizes, materialize(rates(sizes)))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, each as often as the mix takes it, with all their columns.

    The plan is joined to ids and sources alone; the rows stay where they are if
    it is small, as Spark sees then.
    """
    plan = materialize(rates(materialize(measured(docs))))
    rows = wrapped(docs, "doc_id", "source", "text").withColumn("key", key()).drop("text", "doc_id")
    rows = joined(rows, plan.select("source", "rate", "seed", "rows"))
    return rows.withColumn("n", copies()).filter("n > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("_row.*")
