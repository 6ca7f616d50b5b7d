"""Render telemetry: latest states, roll-ups, and events thinned out by time."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutlist.functions.text import finite, round_half_up
from cutlist.sources.shared import materialize

#: Milliseconds between emitted snapshots, statuses that count as rendering.
THROTTLE_MS = 200
ACTIVE = ("rendering", "normalizing", "concatenating", "overlaying")
#: A block of a batch, in multiples of the time between snapshots; at least 2.
BLOCK = 50


def cell_status(status: Column) -> Column:
    """Status of a cell of the matrix."""
    return F.when(status.isNull(), "idle").when(status.isin("done", "error"), status).when(status.isin(*ACTIVE), "rendering").otherwise("queued")


def phase_percent(phase: Column, percent: Column) -> Column:
    """Percent of a job from the percent of its phase: a fifth is concat, the rest overlay."""
    safe = F.when(finite(percent), F.greatest(F.lit(0.0), F.least(F.lit(100.0), percent))).otherwise(0.0)
    return F.when(phase == "concat", round_half_up(safe * 0.2)).otherwise(round_half_up(20 + safe * 0.8))


def exact_percent(percent: Column) -> Column:
    """A percent as a decimal, so that sums don't depend on the order of their rows; 0 if it is not finite."""
    return F.when(finite(percent), percent).when(percent.isNotNull(), 0.0).cast("decimal(26,18)")


def mean_percent(total: Column, n: Column) -> Column:
    """Nearest whole number to the mean of ``n`` exact percents, halves upward."""
    return F.floor(total / n + F.lit(Decimal("0.5"))).cast("long")


def latest(events: DataFrame) -> DataFrame:
    """batch_id, job_id and the state with the largest seq; partial maxima are taken before the shuffle."""
    return events.groupBy("batch_id", "job_id").agg(F.max_by(F.struct("seq", "status", "pct"), "seq").alias("s")).select("batch_id", "job_id", "s.*")


def drop_superseded(events: DataFrame, *keys: str) -> DataFrame:
    """Events of the newest run of each key."""
    newest = W.partitionBy(*keys)
    return events.withColumn("newest", F.max("run_id").over(newest)).filter("run_id = newest").drop("newest")


def overall(latest_: DataFrame) -> DataFrame:
    """batch_id, done, error, canceled, total, percent."""
    return latest_.groupBy("batch_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("done", "error", "canceled")],
        F.count("*").alias("total"),
        mean_percent(F.sum(exact_percent(F.col("pct"))), F.count("*")).alias("percent"),
    )


def batch_outcome(latest_: DataFrame, jobs: DataFrame) -> DataFrame:
    """batch_id, verdict, first_output (of the first job done, in the jobs' order)."""
    rows = latest_.join(jobs.select("job_id", "ord", "output_path"), "job_id", "left")
    done = F.col("status") == "done"
    out = rows.groupBy("batch_id").agg(
        F.count_if(F.col("status") == "canceled").alias("canceled"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.min_by("output_path", F.when(done, F.col("ord"))).alias("first_output"),
    )
    verdict = F.when(F.col("canceled") > 0, "canceled").when(F.col("errors") == 0, "success").otherwise("errors")
    return out.select("batch_id", verdict.alias("verdict"), "first_output")


def matrix(combos: DataFrame, jobs: DataFrame, latest_: DataFrame) -> DataFrame:
    """combo_id, job_id, cell, phase, pct, error: the state of each combo's cell; ``latest_`` has job_id, status, pct and perhaps error."""
    error = F.col("error") if "error" in latest_.columns else F.lit(None).cast("string")
    rows = combos.select("combo_id").join(jobs.select("combo_id", "job_id"), "combo_id", "left").join(latest_.select("job_id", "status", "pct", error.alias("error")), "job_id", "left")
    return rows.select("combo_id", "job_id", cell_status(F.col("status")).alias("cell"), F.col("status").alias("phase"), F.coalesce("pct", F.lit(0.0)).alias("pct"), "error")


def _whole_blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows in parts that cut no block (batch_id, block) in two."""
    held: list[pd.DataFrame] = []
    for part in parts:
        if part.empty:
            continue
        key = part[["batch_id", "block"]]
        if held and tuple(held[-1][["batch_id", "block"]].iloc[-1]) != tuple(key.iloc[0]):
            yield pd.concat(held, ignore_index=True)
            held = []
        cuts = np.flatnonzero(_begins(part)[1:]) + 1
        if len(cuts):
            yield pd.concat([*held, part.iloc[: cuts[-1]]], ignore_index=True)
            held = []
        held.append(part.iloc[cuts[-1] :] if len(cuts) else part)
    if held:
        yield pd.concat(held, ignore_index=True)


def _begins(rows: pd.DataFrame) -> np.ndarray:
    """Whether each row is the first of a block."""
    batch, block = rows["batch_id"].to_numpy(), rows["block"].to_numpy()
    return np.r_[True, (batch[1:] != batch[:-1]) | (block[1:] != block[:-1])]


class _Blocks:
    """Whole blocks with, for each row, the row that is sent after it if it is sent itself."""

    def __init__(self, rows: pd.DataFrame, every: int, length: int) -> None:
        n = len(rows)
        self.at = rows["at"].to_numpy(np.int64)
        begins = _begins(rows)
        self.first = np.flatnonzero(begins)
        self.last = np.r_[self.first[1:], n]
        group = np.cumsum(begins) - 1
        self.end = self.last[group]
        # one ascending clock for all blocks, on which no block reaches into the next
        self.base = 4 * length * np.arange(len(self.first))
        self.clock = self.base[group] + self.at
        places = np.arange(n)
        forced = np.where(rows["force_emit"].eq(True).to_numpy(bool), places, n)
        self.forced = np.r_[np.minimum.accumulate(forced[::-1])[::-1], n]
        free = np.maximum(np.searchsorted(self.clock, self.clock + every), places + 1)
        self.next = np.minimum(np.minimum(free, self.forced[1:]), self.end)

    def entry(self, since: np.ndarray) -> np.ndarray:
        """The first row sent in each block if unforced ones are from the time ``since`` on; the block's end if none is."""
        return np.minimum(np.minimum(np.searchsorted(self.clock, self.base + since), self.forced[self.first]), self.last)

    def exits(self) -> np.ndarray:
        """The last row sent in its block if a row is sent."""
        places = np.arange(len(self.at))
        to = np.where(self.next < self.end, self.next, places)
        while (to[to] != to).any():
            to = to[to]
        return to


def _whole_ms(micros: Column) -> Column:
    """Microseconds rounded to milliseconds, halves away from zero."""
    size = F.abs(micros) + 500
    size = size - size % 1000
    return F.when(micros < 0, -size).otherwise(size)


def throttle(events: DataFrame, every_ms: int = THROTTLE_MS, block: int = BLOCK, whole_ms: bool = False) -> DataFrame:
    """Events (batch_id, seq, ts, force_emit) that are sent: forced ones, and those 200 ms after the last sent one.

    Each depends on the one sent before. A batch is cut into blocks of ``block``
    times ``every_ms``. Only the first row that a block sends depends on the block
    before, and it is one of few: those of the block's first 200 ms, up to a forced
    one, or the next after them. Each block tells by itself where it ends from any of
    these. That leads to rows of the next block; most blocks are entered at one row
    however the one before was. For the others the links are doubled until all
    entries are known, in as many rounds as the logarithm of the longest chain of
    such blocks. So one batch is spread over all tasks, and a task holds the events
    of some blocks.

    Rows of equal time go by ``seq``. Rows without batch or time are left out. With
    ``whole_ms`` the time between two is told by a clock of milliseconds, to which
    times are rounded; their order stays that of the times themselves.
    """
    every = every_ms * 1000
    length = block * max(every, 1)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    clock = _whole_ms(micros) if whole_ms else micros
    placed = events.filter("batch_id is not null and ts is not null").withColumn("block", F.floor(clock / length).cast("long")).withColumn("at", F.pmod(clock, F.lit(length)))
    order = ["at", "seq"]
    if whole_ms:
        placed, order = placed.withColumn("exact", micros), ["at", "exact", "seq"]
    batch = events.schema["batch_id"].dataType.simpleString()

    def sorted_blocks(rows: DataFrame) -> DataFrame:
        return rows.repartition("batch_id", "block").sortWithinPartitions("batch_id", "block", *order)

    def ends(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _whole_blocks(parts):
            b = _Blocks(part, every, length)
            out = b.exits()
            # the row that is entered from the block's first 200 ms on, and those before it, one for each time
            limit = b.entry(np.full(len(b.first), every))
            before = np.arange(len(part)) < np.repeat(limit, b.last - b.first)
            early = np.flatnonzero(before & (_begins(part) | np.r_[True, b.at[1:] != b.at[:-1]]))
            sends = limit < b.last
            left = np.where(sends, b.at[out[np.where(sends, limit, b.first)]], -2 * length)
            at = np.r_[early, b.first]
            yield pd.DataFrame({
                "batch_id": part["batch_id"].to_numpy()[at],
                "block": part["block"].to_numpy()[at],
                "since": np.r_[b.at[early], np.full(len(b.first), every)],
                "left": np.r_[b.at[out[early]], left],
            })

    narrow = placed.select("batch_id", "block", *order, "force_emit")
    doors = materialize(sorted_blocks(narrow).mapInPandas(ends, f"batch_id {batch}, block long, since long, left long"))
    entered = materialize(_entered(doors, every, length))

    def send(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _whole_blocks(parts):
            since = part["since"].to_numpy()[part["at"].to_numpy() < 0].astype(np.int64)
            rows = part[part["at"] >= 0].reset_index(drop=True)
            b = _Blocks(rows, every, length)
            keep = np.zeros(len(rows), bool)
            now = b.entry(since)
            now = now[now < b.last]
            while len(now):
                keep[now] = True
                then = b.next[now]
                now = then[then < b.end[now]]
            yield rows[keep]

    # a block's entry comes first among its rows
    rows = placed.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("since", F.lit(None).cast("long"))
    entered = entered.withColumns({c: F.lit(-1).cast("long") for c in order if c != "seq"})
    rows = rows.unionByName(entered, allowMissingColumns=True)
    return sorted_blocks(rows).mapInPandas(send, rows.schema).select(*[F.col(f.name).cast(f.dataType) for f in events.schema])


def _entered(doors: DataFrame, every: int, length: int) -> DataFrame:
    """batch_id, block, since: the door by which each block is entered, of all its doors with the times at which they leave it."""
    by = W.partitionBy("batch_id", "block").orderBy(F.desc("at"), F.desc("door"))
    comes = doors.select("batch_id", (F.col("block") + 1).alias("block"), (F.col("left") + every - length).alias("at"), F.lit(False).alias("door"), F.col("since").alias("came"))
    both = doors.select("batch_id", "block", F.col("since").alias("at"), F.lit(True).alias("door"), F.lit(None).cast("long").alias("came")).unionByName(comes)
    # the first door at that time or later
    both = both.withColumn("since", F.last(F.when(F.col("door"), F.col("at")), ignorenulls=True).over(by))
    links = materialize(both.filter("since is not null"))
    least = lambda c, of: F.min(F.when(F.col("door") if of else ~F.col("door"), F.col(c)))
    blocks = links.groupBy("batch_id", "block").agg(
        least("since", True).alias("first"), least("since", False).alias("a"), F.max(F.when(~F.col("door"), F.col("since"))).alias("b")
    )
    blocks = blocks.withColumn("since", F.when(F.col("a").isNull(), F.col("first")).when(F.col("a") == F.col("b"), F.col("a")))
    found = blocks.filter("since is not null").select("batch_id", "block", "since")
    unknown = blocks.filter("since is null").select("batch_id", "block")
    edges = links.filter("not door").select("batch_id", "block", "since", (F.col("block") - 1).alias("of"), "came")
    edges = materialize(edges.join(unknown, ["batch_id", "block"], "left_semi"))
    while not edges.isEmpty():
        here = found.select("batch_id", F.col("block").alias("of"), F.col("since").alias("came"))
        found = materialize(found.unionByName(edges.join(here, ["batch_id", "of", "came"], "left_semi").select("batch_id", "block", "since")))
        then = edges.select("batch_id", F.col("block").alias("to"), F.col("since").alias("by"), F.col("of").alias("block"), F.col("came").alias("since"))
        twice = edges.join(then, ["batch_id", "block", "since"])
        edges = materialize(twice.select("batch_id", F.col("to").alias("block"), F.col("by").alias("since"), "of", "came"))
    return found
