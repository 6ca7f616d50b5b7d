"""Structured Streaming forms of the telemetry jobs; on the same events they agree with the batch forms."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cutlist.operators import errors, progress
from cutlist.sources.store import KeyedStore


def latest_progress(events: DataFrame) -> DataFrame:
    """Running latest state of each job, for update mode."""
    return progress.latest(events)


JOBS = "batch_id long, job_id long, seq long, status string, pct double"
TOTALS = "batch_id long, done long, error long, canceled long, total long, pct decimal(37,18)"


def _stores(spark: SparkSession, path: str) -> tuple[KeyedStore, KeyedStore]:
    return KeyedStore(spark, f"{path}/jobs", JOBS, ("batch_id", "job_id")), KeyedStore(spark, f"{path}/totals", TOTALS, ("batch_id",))


def overall_progress(events: DataFrame, path: str, checkpoint: str):
    """Writer that keeps the roll-up of all latest states in stores under ``path``.

    A trigger hands on the jobs that changed. What each adds to its batch, less
    what its state before had added, goes to the batch's totals, so a trigger
    writes a row for each changed job and batch, however many there are. Versions
    are the triggers' numbers and read those before alone: a trigger that is run
    again gives the same.
    """
    jobs, totals = (s.create() for s in _stores(events.sparkSession, path))
    states = ("done", "error", "canceled")

    def of(side: str) -> list:
        there = F.col(f"{side}.seq").isNotNull().cast("long")
        return [*[F.coalesce((F.col(f"{side}.status") == s).cast("long"), F.lit(0)) for s in states], there, F.coalesce(progress.exact_percent(F.col(f"{side}.pct")), F.lit(0))]

    def step(frame: DataFrame, k: int) -> None:
        jobs.append(frame, k)
        changed, before = jobs.version(k), jobs.read(k - 1)
        both = changed.alias("now").join(before.alias("was"), ["batch_id", "job_id"], "left")
        names = (*states, "total", "pct")
        delta = both.groupBy("batch_id").agg(*[F.sum(a - b).alias(n) for n, a, b in zip(names, of("now"), of("was"), strict=True)])
        sums = delta.alias("d").join(totals.read(k - 1).alias("t"), "batch_id", "left")
        totals.append(sums.select("batch_id", *[(F.col(f"d.{n}") + F.coalesce(F.col(f"t.{n}"), F.lit(0))).cast("decimal(37,18)" if n == "pct" else "long").alias(n) for n in names]), k)

    return latest_progress(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(step)


def overall(spark: SparkSession, path: str) -> DataFrame:
    """batch_id, done, error, canceled, total, percent of what ``overall_progress`` keeps under ``path``."""
    rows = _stores(spark, path)[1].read()
    return rows.select("batch_id", "done", "error", "canceled", "total", progress.mean_percent(F.col("pct"), F.col("total")).alias("percent"))


def classify_errors(lines: DataFrame) -> DataFrame:
    """``lines`` (raw) with code and hint, for append mode."""
    return lines.withColumn("code", errors.code(F.col("raw"))).withColumn("hint", errors.classify(F.col("raw")))


def _timeout(forget_ms: int | None) -> str:
    """Without a limit state is kept for ever. A stream with one wakes to forget, so it runs on: it fits no trigger that ends with its input."""
    return GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def throttle(events: DataFrame, every_ms: int = progress.THROTTLE_MS, forget_ms: int | None = None) -> DataFrame:
    """Events that are sent, by event time: forced ones, and those 200 ms after the last sent; one time is kept for each batch id.

    The same as the batch form with ``whole_ms`` if events come in their order; one that comes
    after a later one of its batch is held against the last that was sent. What
    is kept for a batch goes ``forget_ms`` after its last event, if given.
    """

    def walk(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["ts", "seq"])
        keep = []
        micros = rows["ts"].astype("datetime64[ns]").astype("int64") // 1000
        for ts, force in zip(np.sign(micros) * ((micros.abs() + 500) // 1000), rows["force_emit"], strict=True):
            send = bool(force) or last is None or ts - last >= every_ms
            last = ts if send else last
            keep.append(send)
        state.update((int(last),))
        if forget_ms is not None:
            state.setTimeoutDuration(forget_ms)
        yield rows[keep]

    cast = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return cast.groupBy("batch_id").applyInPandasWithState(walk, cast.schema, "last long", "append", _timeout(forget_ms))


def drop_superseded(events: DataFrame, key: str = "job_id", forget_ms: int | None = None) -> DataFrame:
    """Events unless a newer run of their key has been seen; the newest run id is the state.

    Unlike the batch form, which knows all runs, it lets an older run's events
    through that come before the newer run does.
    """

    def walk(k: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest = state.get[0] if state.exists else None
        rows = pd.concat(list(parts))
        newest = int(max(rows["run_id"].max(), newest if newest is not None else rows["run_id"].max()))
        state.update((newest,))
        if forget_ms is not None:
            state.setTimeoutDuration(forget_ms)
        yield rows[rows["run_id"] == newest]

    return events.groupBy(key).applyInPandasWithState(walk, events.schema, "newest long", "append", _timeout(forget_ms))
