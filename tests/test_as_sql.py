"""Queries against their SQL on small tables that hold what larger ones do."""

import datetime as dt
import itertools
import pathlib

import __spark_entry__ as driver
import duckdb
import pytest

from cutlist.operators import captions, progress
from cutlist.streaming import stream

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def both(spark, path, name, **tables):
    """Sorted rows of a query and of its SQL over ``tables`` (rows, schema)."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{path}/{table}.parquet/*.parquet'")
    got = driver.queries()[name](spark, str(path))
    columns = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = con.execute(f"select {quoted} from ({driver.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.select(columns).collect()), key=str), sorted(want, key=str)


@pytest.mark.parametrize("name", ["progress_throttle", "stream_throttle"])
def test_throttle_by_whole_milliseconds(spark, tmp_path, name):
    t0 = dt.datetime(2024, 1, 1)
    times = {
        1: (0, 199_499, 199_500, 399_499),  # 199 ms, then 200 ms
        2: (499, 199_998, 200_499, 200_500),  # from 0 ms
        3: (500, 200_499, 200_500),  # from 1 ms
        4: (10_003, 10_002, 10_001, 210_100, 210_050),  # ids against time within a millisecond
        5: (9_999_600, 10_199_400, 10_199_600),  # the first is rounded into the next block
    }
    rows = [(10 * b + k, t0 + dt.timedelta(microseconds=t), 10 * b, "view", 1.0, "") for b, of in times.items() for k, t in enumerate(of) if (10 * b + k) % 9]
    got, want = both(spark, tmp_path, name, events=(rows, EVENTS))
    assert got == want and len(got) < len(rows)


#: A mean of 30.5, which sums of doubles miss in some orders; and means under halves that six digits don't tell from them.
ORDERS = list(itertools.permutations((28.19, 10.55, 70.91, 12.35)))
CLOSE = [((49.4999997,), 49), ((60.0, None, 39.0), 33), ((float("nan"), 1.0), 1), ((99.0, -0.0000001), 49)]
LATEST = "batch_id long, job_id long, seq long, status string, pct double"


def states(batches):
    return [(b, 10 * b + k, k, "done", p) for b, of in enumerate(batches) for k, p in enumerate(of)]


def test_mean_percent_is_exact(spark):
    rows = spark.createDataFrame(states([*ORDERS, *[of for of, _ in CLOSE]]), LATEST).coalesce(1)
    got = [r.percent for r in progress.overall(rows).orderBy("batch_id").collect()]
    assert got == [31] * len(ORDERS) + [n for _, n in CLOSE]


def test_streamed_mean_percent_is_exact(spark, tmp_path):
    spark.createDataFrame(states([*ORDERS[:3], *[of for of, _ in CLOSE]]), LATEST).write.parquet(f"{tmp_path}/events")
    events = spark.readStream.schema(LATEST).parquet(f"{tmp_path}/events")
    stream.overall_progress(events, f"{tmp_path}/kept", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)
    got = [r.percent for r in stream.overall(spark, f"{tmp_path}/kept").orderBy("batch_id").collect()]
    assert got == [31] * 3 + [n for _, n in CLOSE]


def exchanges(df):
    """How often a plan moves rows, before it is run."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_captions_move_jobs_few_times(spark):
    made = driver.queries()["captions_build"](spark, "/root/testdata/sf0.001")
    print("exchanges", exchanges(made))
    assert exchanges(made) <= 10


def test_captions_of_odd_inputs(spark):
    inf = float("inf")
    timeline = [("a", 0, "/p", 0.0, 1000.0), ("a", 1, "/p", 1000.0, 0.0), ("b", 0, "/none", 0.0, 500.0), ("c", 0, "/p", inf, 500.0), ("d", 0, "/p", -5.0, 100.0), ("d", 1, "/p", None, 100.0), ("e", 0, "/p", 0.0, 9.0)]
    spoken = spark.createDataFrame([("/p", k, f"w{k}", 0.4 * k, 0.4 * k + 0.3) for k in (2, 1, 0, 3)] + [("/p", 4, " ", 9.0, 9.5)], "path string, idx int, text string, start double, end double")
    styles = spark.createDataFrame([(0, 2, "karaoke-fill", "Karaoke", "K"), (1, 3, "fade-in", "FadeIn", "F")], "style_id int, words_per_line int, animation string, style_name string, header string")
    line = lambda a, b, name, text: f"Dialogue: 0,0:00:0{a:.2f},0:00:0{b:.2f},{name},,0,0,0,,{text}"
    sung = lambda *ws: " ".join("{\\kf%d}w%d" % w for w in ws)
    want = {
        "a": "K\n" + "\n".join([line(0, 0.7, "Karaoke", sung((30, 0), (30, 1))), line(0.8, 1, "Karaoke", sung((20, 2))), line(1, 1.7, "Karaoke", sung((30, 0), (30, 1))), line(1.8, 2.5, "Karaoke", sung((30, 2), (30, 3)))]) + "\n",
        "b": "F\n\n",
        "d": "F\n" + line(0, 0.1, "FadeIn", "{\\fad(200,200)}w0") + "\n",
    }
    of = spark.createDataFrame([("a", 0), ("b", 1), ("c", 0), ("d", 1)], "job_id string, style_id int")
    rows = spark.createDataFrame(timeline, "job_id string, seg int, path string, offset_ms double, duration_ms double")
    assert {r.job_id: r.ass for r in captions.build(rows, spoken, styles, of).collect()} == want
    assert {r.job_id: r.ass for r in captions.build(rows.join(of, "job_id"), spoken, styles).collect()} == want


def test_simple_captions_stay_with_their_source(spark):
    assert exchanges(driver.queries()["captions_simple"](spark, "/root/testdata/sf0.001")) == 1


def shuffle_files(spark):
    return {f for f in pathlib.Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}


def left_behind(spark, name):
    """Shuffle files that are there once a query is made, before its rows are asked for."""
    before = shuffle_files(spark)
    made = driver.queries()[name](spark, "/root/testdata/sf0.001")
    return made, shuffle_files(spark) - before


def test_words_in_segments_make_words_once(spark):
    made, left = left_behind(spark, "words_in_segments")
    assert not left and exchanges(made) <= 3


def test_repeats_are_marked_once(spark):
    for name in ("words_normalize_chunks", "words_merge_recovered"):
        made, left = left_behind(spark, name)
        assert not left and exchanges(made) <= 2, name


@pytest.mark.parametrize("name", ["io_transcripts_round_trip", "markers_detect", "qa_run", "qa_nudge"])
def test_stored_tables_leave_no_shuffles(spark, name):
    assert not left_behind(spark, name)[1]
