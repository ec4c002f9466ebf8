import datetime

from docweave.streaming.jobs import batch_events, exactly_once, request_windows


def _drain(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_one_event_a_batch(spark, tmp_path):
    schema = "batch_id long, total_items long, was string, now string"
    parts = [
        [(1, 2, None, "pending"), (1, 2, None, "pending"), (2, 1, None, "running")],
        [(1, 2, "pending", "succeeded"), (2, 1, "running", "failed")],
        [(1, 2, "pending", "cancelled"), (2, 1, "failed", "succeeded"), (3, 1, None, "succeeded")],
    ]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    _drain(batch_events(stream), "batch_events")
    got = {r.batch_id: r.status for r in spark.table("batch_events").collect()}
    assert got == {1: "partially_failed", 2: "failed", 3: "completed"} and spark.table("batch_events").count() == 3


def test_state_of_finished_batches_goes(spark, tmp_path):
    """A change that comes long after the end finds no state: the batch counts as new."""
    schema = "batch_id long, total_items long, was string, now string, ts timestamp"
    t = lambda d: datetime.datetime(2024, 1, d)
    parts = [[(1, 1, None, "succeeded", t(1))], [(1, 1, None, "succeeded", t(1))], [(9, 5, None, "pending", t(20))], [(9, 5, None, "pending", t(21))], [(1, 1, None, "succeeded", t(21))]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    _drain(batch_events(stream, "ts", remember=24 * 3600), "dropped_events")
    assert [r.batch_id for r in spark.table("dropped_events").collect()] == [1, 1]


def test_windows_and_duplicates(spark, tmp_path):
    t = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, t(0), "a"), (1, t(0), "a"), (2, t(0), "b"), (1, t(1), "b"), (9, t(59), "z")]
    spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string").coalesce(1).write.parquet(f"{tmp_path}/r")
    stream = spark.readStream.schema("user_id long, ts timestamp, event_type string").parquet(f"{tmp_path}/r")
    _drain(request_windows(stream, limit=1), "request_windows")
    got = sorted((r.user_id, r.n, r.allowed) for r in spark.table("request_windows").collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1)]
    _drain(exactly_once(stream.withColumnRenamed("user_id", "batch_id")), "exactly_once")
    assert spark.table("exactly_once").count() == 4
