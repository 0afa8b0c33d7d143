"""Windowed collisions of a stream: late, repeated and too late rows."""

from datetime import datetime, timedelta

import pytest

from quantaloom.streaming import monitor

START = datetime(2024, 1, 1)
SCHEMA = "idx long, ts timestamp, codes array<int>"


def at(minutes):
    return START + timedelta(minutes=minutes)


def streamed(spark, folder, deliveries, **options):
    """The windows that come out when each delivery is a micro-batch."""
    for rows in deliveries:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    found = monitor.collision_windows(stream, **options)
    sink = found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    sink.start(f"{folder}/out").awaitTermination()
    return found.schema


def windows(df):
    return [(r.window_start, r.rows, r.unique_paths, r.collisions, r.largest_bucket) for r in df.orderBy("window_start").collect()]


def test_late_and_repeated_rows_count_once(spark, tmp_path):
    first = [(1, at(5), [1, 2]), (2, at(10), [1, 2]), (3, at(70), [3, 4]), (4, None, [9]), (5, at(20), None)]
    # a late row, a row that comes again, and the same path in another window
    second = [(6, at(30), [1, 2]), (2, at(10), [1, 2]), (7, at(80), [1, 2])]
    closing = [(99, at(100_000), [0])]
    schema = streamed(spark, tmp_path, [first, second, closing], width="1 hour", delay="3 hours")
    got = spark.read.schema(schema).parquet(f"{tmp_path}/out")
    assert windows(got) == [(at(0), 3, 1, 2, 3), (at(60), 2, 2, 0, 1)]
    assert [r.collision_rate for r in got.orderBy("window_start").collect()] == pytest.approx([2 / 3, 0.0])
    table = spark.createDataFrame(first + second, SCHEMA)
    assert windows(monitor.collision_windows(table)) == windows(got)


def test_rows_later_than_the_delay_are_left_out(spark, tmp_path):
    deliveries = [[(1, at(5), [1])], [(2, at(600), [1])], [(3, at(610), [1])], [(4, at(6), [1])], [(99, at(100_000), [0])]]
    schema = streamed(spark, tmp_path, deliveries, width="1 hour", delay="1 hour")
    got = spark.read.schema(schema).parquet(f"{tmp_path}/out")
    assert windows(got) == [(at(0), 1, 1, 0, 1), (at(600), 2, 1, 1, 2)]


def test_a_restarted_stream_goes_on(spark, tmp_path):
    streamed(spark, tmp_path, [[(1, at(5), [1])], [(2, at(200), [1])]], width="1 hour", delay="1 hour")
    schema = streamed(spark, tmp_path, [[(3, at(210), [1])], [(99, at(100_000), [0])]], width="1 hour", delay="1 hour")
    got = spark.read.schema(schema).parquet(f"{tmp_path}/out")
    assert windows(got) == [(at(0), 1, 1, 0, 1), (at(180), 2, 1, 1, 2)]


def test_sliding_windows_and_an_empty_table(spark):
    rows = [(1, at(50), [1]), (2, at(70), [1])]
    got = monitor.collision_windows(spark.createDataFrame(rows, SCHEMA), width="1 hour", slide="30 minutes")
    assert windows(got) == [(at(0), 1, 1, 0, 1), (at(30), 2, 1, 1, 2), (at(60), 1, 1, 0, 1)]
    assert monitor.collision_windows(spark.createDataFrame([], SCHEMA)).count() == 0
