"""Transcript caches: which clips need work, and what came of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlist.functions.text import finite
from cutlist.sources.store import KeyedStore


def valid_signature(size: Column, mtime: Column) -> Column:
    return F.coalesce(finite(size.cast("double")) & (size >= 0) & finite(mtime.cast("double")) & (mtime >= 0), F.lit(False))


def inspect_cache(clips: DataFrame, model: str, cache: DataFrame, inventory: DataFrame) -> DataFrame:
    """path, state, pending for each distinct clip path: hit, stale, absent, or unavailable (no valid source).

    A hit has the same model, size and time as the source now. Only narrow
    columns are joined; words are fetched after.
    """
    paths = clips.select("path").distinct()
    now = inventory.select("path", "size", "mtime_ms")
    had = cache.select("path", F.col("model").alias("c_model"), F.col("size").alias("c_size"), F.col("mtime_ms").alias("c_mtime"))
    rows = paths.join(now, "path", "left").join(had, "path", "left")
    same = (F.col("c_model") == model) & (F.col("c_size") == F.col("size")) & (F.col("c_mtime") == F.col("mtime_ms"))
    state = F.when(~valid_signature(F.col("size"), F.col("mtime_ms")), "unavailable").when(F.col("c_model").isNull(), "absent").when(same, "hit").otherwise("stale")
    return rows.select("path", state.alias("state")).withColumn("pending", F.col("state") != "hit")


def evict(cache: DataFrame, states: DataFrame) -> DataFrame:
    """``cache`` without the entries that are stale."""
    return cache.join(states.filter("state = 'stale'").select("path"), "path", "left_anti")


def prepare(states: DataFrame, attempts: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """path, outcome, failure: cached, transcribed, or failed by model, source or transcription.

    ``attempts`` has path, model_ok and ok for pending paths. A new transcript
    counts only if the source has the same signature before and after.
    """
    a = before.select("path", F.col("size").alias("s0"), F.col("mtime_ms").alias("m0"))
    b = after.select("path", F.col("size").alias("s1"), F.col("mtime_ms").alias("m1"))
    rows = states.join(attempts.select("path", "model_ok", "ok"), "path", "left").join(a, "path", "left").join(b, "path", "left")
    still = valid_signature(F.col("s0"), F.col("m0")) & F.coalesce((F.col("s0") == F.col("s1")) & (F.col("m0") == F.col("m1")), F.lit(False))
    failure = (
        F.when(F.col("state") == "hit", None)
        .when(~F.coalesce("model_ok", F.lit(False)), "model")
        .when((F.col("state") == "unavailable") | ~still, "source")
        .when(~F.coalesce("ok", F.lit(False)), "transcription")
    )
    rows = rows.withColumn("failure", failure)
    outcome = F.when(F.col("failure").isNotNull(), "failed").when(F.col("state") == "hit", "cached").otherwise("transcribed")
    return rows.select("path", outcome.alias("outcome"), "failure")


def renewed(cache: DataFrame, outcomes: DataFrame, model: str, after: DataFrame) -> DataFrame:
    """path, model, size, mtime_ms: the cache after ``prepare``: what was written anew, and the old entries of all other paths that ``prepare`` did not find stale."""
    made = outcomes.filter("outcome = 'transcribed'").join(after.select("path", "size", "mtime_ms"), "path").select("path", F.lit(model).alias("model"), "size", "mtime_ms")
    old = cache.select("path", "model", "size", "mtime_ms")
    kept = old.join(outcomes.filter("outcome <> 'cached'").select("path"), "path", "left_anti")
    return kept.unionByName(made)


CACHE = "path string, model string, size long, mtime_ms long"


def cache_store(spark: SparkSession, path: str) -> KeyedStore:
    """The cache as a store that eviction and renewal change."""
    return KeyedStore(spark, path, CACHE, ("path",)).create()


def renew(store: KeyedStore, states: DataFrame, outcomes: DataFrame, model: str, after: DataFrame, version: int) -> None:
    """Two versions of the store: from ``version`` on entries that were stale are gone, from the next on what was transcribed is there."""
    store.append(states.filter("state = 'stale'").select("path"), version, gone=True)
    made = outcomes.filter("outcome = 'transcribed'").join(after.select("path", "size", "mtime_ms"), "path")
    store.append(made.select("path", F.lit(model).alias("model"), F.col("size").cast("long").alias("size"), F.col("mtime_ms").cast("long").alias("mtime_ms")), version + 1)


def summary(outcomes: DataFrame, *keys: str) -> DataFrame:
    """keys, total, success, cached, transcribed and failures by kind, of all outcomes that share the keys."""
    kinds = [F.count_if(F.col("failure") == k).alias(f"failed_{k}") for k in ("model", "source", "transcription")]
    done = [F.count_if(F.col("outcome") == k).alias(k) for k in ("cached", "transcribed")]
    return outcomes.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("outcome") != "failed").alias("success"), *done, *kinds)
