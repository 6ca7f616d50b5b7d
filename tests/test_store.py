"""A keyed store: newest rows, removals, compaction, and renewal of a transcript cache."""

from cutlist.operators import transcripts
from cutlist.sources.store import KeyedStore


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_store(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", "k string, x long", ("k",)).create()
    put = lambda some: spark.createDataFrame(some, "x long, k string, other int")
    assert rows(store.read()) == []
    store.append(put([(1, "a", 0), (2, "b", 0)]), 0)
    store.append(put([(3, "a", 0), (None, "c", 0)]), 1)
    assert rows(store.read(0)) == [("a", 1), ("b", 2)]
    store.append(put([(0, "b", 0), (0, "never", 0)]), 2, gone=True)
    want = [("a", 3), ("c", None)]
    assert sorted(rows(store.read()), key=str) == want
    # a compaction that breaks off before its base is in the manifest has no effect, and can be run again
    store._newest(1).select("k", "x", "gone").limit(1).write.parquet(f"{tmp_path}/s/base/v=1")
    assert sorted(rows(store.read()), key=str) == want
    store.compact(1)
    assert sorted(rows(store.read()), key=str) == want and rows(store.read(0)) == [("a", 1), ("b", 2)]
    store.compact(2)
    store.append(put([(9, "b", 0)]), 3)
    store.append(put([(9, "b", 0)]), 3)  # again, as after a lost driver
    again = KeyedStore(spark, f"{tmp_path}/s", "k string, x long", ("k",)).create()
    assert sorted(rows(again.read()), key=str) == [*want[:1], ("b", 9), *want[1:]]


def test_renewal_changes_the_store(spark, tmp_path):
    store = transcripts.cache_store(spark, f"{tmp_path}/c")
    table = lambda some: spark.createDataFrame(some, "path string, model string, size long, mtime_ms long")
    store.append(table([("/hit", "base", 1, 1), ("/stale", "base", 1, 1), ("/lost", "base", 1, 1), ("/other", "base", 7, 7)]), 0)
    clips = spark.createDataFrame([("/hit",), ("/stale",), ("/lost",), ("/new",)], "path string")
    now = spark.createDataFrame([("/hit", 1, 1), ("/stale", 2, 2), ("/lost", 3, 3), ("/new", 4, 4)], "path string, size long, mtime_ms long")
    states = transcripts.inspect_cache(clips, "base", store.read(), now)
    attempts = spark.createDataFrame([("/stale", True, True), ("/lost", True, False), ("/new", True, True)], "path string, model_ok boolean, ok boolean")
    outcomes = transcripts.prepare(states, attempts, now, now)
    want = [("/hit", "base", 1, 1), ("/new", "base", 4, 4), ("/other", "base", 7, 7), ("/stale", "base", 2, 2)]
    transcripts.renew(store, states, outcomes, "base", now, 1)
    assert rows(store.read()) == want
    assert [r[0] for r in rows(store.read(1))] == ["/hit", "/other"]  # a driver lost between: stale entries are gone, nothing is wrong
    store.compact(2)
    assert rows(store.read()) == want and {r.path for r in transcripts.inspect_cache(clips, "base", store.read(), now).filter("pending").collect()} == {"/lost"}
