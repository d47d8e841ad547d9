import pytest
from pyspark.sql import functions as F

from attestor.streaming import admission as ad
from attestor.streaming import jobs

ROWS = [("u", i, t) for i, t in enumerate([0.0, 10.0, 20.0, 3600.0, 3601.0, 3611.0, 9000.0])] + [("v", 100, 5.0)]


def test_admission_keeps_an_hour_and_counts_admitted_only():
    assert ad.admit([0, 10, 20, 3600, 3601], [], 2)[0] == [True, True, False, False, True]


def test_ledger_waits_and_refuses():
    out = ad.ledger([(0.0, 900), (1.0, 900), (2.0, 5000)], 2000)
    assert out == [(0.0, True), (59.0, True), (0.0, False)]
    assert ad.ledger([(0.0, 7040)], 8000) == [(0.0, True)] and ad.ledger([(0.0, 7041)], 8000) == [(0.0, False)]


def test_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    df = spark.createDataFrame(ROWS, "key string, request long, t double")
    df.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    got = {(r.key, r.request): r.admitted for r in jobs.drain(ad.admission_stream(stream, 2), "admitted", "append").collect()}
    batch = ad.admission_batch(df.withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long"))), "key", "request", "ts", 2)
    assert got == {(r.key, r.request): r.admitted for r in batch.collect()}


def test_resume_and_dedupe(spark, tmp_path):
    path = str(tmp_path / "ev")
    df = spark.sql("SELECT id % 4 AS event_id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts FROM range(8)")
    df.coalesce(1).write.parquet(path)
    stream = jobs.as_events(spark.readStream.schema(df.schema).parquet(path))
    once = jobs.drain(jobs.delivered_once(jobs.resume(stream, 1), ["event_id"]), "once")
    assert sorted(r.event_id for r in once.collect()) == [2, 3]


@pytest.mark.parametrize("mode", ["complete"])
def test_days(spark, tmp_path, mode):
    path = str(tmp_path / "d")
    df = spark.sql("SELECT id AS event_id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id * 12) AS ts FROM range(5)")
    df.coalesce(1).write.parquet(path)
    stream = jobs.as_events(spark.readStream.schema(df.schema).parquet(path))
    rows = jobs.drain(jobs.per_day(stream), "days", mode).collect()
    assert sorted((str(r.day), r.n) for r in rows) == [("2024-01-01", 2), ("2024-01-02", 2), ("2024-01-03", 1)]


def test_a_ledger_with_a_long_queue_holds_no_more_than_a_budget():
    """Three calls a minute more than fit: the wait grows by theirs, what is held does not."""
    held, waits = ad.Ledger(1800), []
    for i in range(30_000):
        waits.append(held.charge(12.0 * i, 900)[0])
        assert len(held.held) <= 2
    assert waits[:5] == [0.0, 0.0, 36.0, 36.0, 72.0] and waits[-1] == 60.0 * (29_999 // 2) - 12.0 * 29_998 + 0.0
