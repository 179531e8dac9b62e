"""The stream's report equals the batch aggregation, whatever the number of triggers."""

import pytest
from pyspark.sql import functions as F

from vocalgrid.session import new_location
from vocalgrid.streaming.progress import WindowSums, run_progress, windowed_progress


@pytest.mark.parametrize("max_files", [None, 1])
def test_stream_equals_batch(spark, max_files):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type")
    where = new_location(spark, "incoming")
    events.repartitionByRange(4, "ts").write.parquet(where)
    done = (F.col("event_type") != "error").cast("long")
    got = run_progress(spark, where, events.schema, "ts", "6 hours", done, F.lit(1), max_files=max_files)
    want = events.groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(
        F.count(F.lit(1)).alias("expected"), F.sum(done).alias("done")
    )
    left = sorted((r["window_start"], r["expected"], r["done"]) for r in got.collect())
    right = sorted((r["w"]["start"], r["expected"], r["done"]) for r in want.collect())
    assert left == right and len(left) > 3


@pytest.mark.parametrize("compact", [2, 100])
def test_late_rows_count_and_no_state_is_kept(spark, compact):
    where = new_location(spark, "late")
    rows = [(f"2024-0{1 + k % 6}-11 0{k % 9}:30:00", k % 3) for k in range(60)] + [("2023-01-11 05:00:00", 0), ("2023-01-11 05:10:00", 1)]
    df = spark.createDataFrame(rows, "ts string, ok int").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(6):  # the year-old rows come with the last file
        df.where(F.month("ts") == k + 1 if k < 5 else (F.month("ts") == 6) | (F.year("ts") == 2023)).where((F.year("ts") == 2024) | F.lit(k == 5)).write.mode("append").parquet(where)
    done = (F.col("ok") > 0).cast("long")
    got = run_progress(spark, where, df.schema, "ts", "1 hour", done, F.lit(1), max_files=1, compact=compact)
    want = windowed_progress(df, "ts", "1 hour", done, F.lit(1))
    shown = lambda x: sorted(map(tuple, x.select("window_start", "expected", "done").collect()))
    assert shown(got) == shown(want)
    progress = spark.readStream.schema(df.schema).parquet(where).writeStream.foreachBatch(lambda b, n: None).trigger(availableNow=True).option("checkpointLocation", new_location(spark, "s")).start()
    progress.awaitTermination()
    assert all(not p["stateOperators"] for p in progress.recentProgress)


def test_folders_stay_few_and_triggers_may_be_run_again(spark):
    sums = WindowSums(spark, new_location(spark, "sums"), compact=4)
    day = lambda k: spark.createDataFrame([(f"2024-01-0{1 + k % 3}", 1, 1)], "window_start string, expected long, done long")
    for k in range(12):
        sums.add(day(k), k)
        sums.add(day(k), k) if len(sums.folders) > 1 else None
        assert len(sums.folders) <= 5
    assert sorted((r["window_start"], r["expected"]) for r in sums.totals().collect()) == [(f"2024-01-0{d}", 4) for d in (1, 2, 3)]


def test_an_empty_source(spark, tmp_path):
    assert run_progress(spark, str(tmp_path), "ts timestamp, ok int", "ts", "1 hour", F.col("ok"), F.lit(1)).collect() == []


@pytest.mark.parametrize("folder", [False, True])
def test_table_as_file_or_folder(spark, folder, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    place = tmp_path / "events.parquet"
    if folder:
        events.repartition(3).write.parquet(str(place))
    else:
        place.symlink_to("/root/testdata/sf0.001/events.parquet")
    got = run_progress(spark, f"{tmp_path}/[e]vents.parquet", events.schema, "ts", "1 day", F.lit(1), F.lit(1))
    assert got.agg(F.sum("done")).first()[0] == events.count()
