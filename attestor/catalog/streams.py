"""Budgets of models over the event table: an event plays a call of the model that its type names, a minute a second."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import made_once
from ..streaming import budget as bu
from .tables import read

PARTS, STORE, ROCKS = "spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CALLS = "model string, call long, ts timestamp, need long, used long, budget long, retry_after double"


def calls_of(spark: SparkSession, d: str) -> DataFrame:
    """One call in forty is refused for 45 seconds; every third one's tokens are settled; one type is not metered."""
    e, n = read(spark, d, "events"), F.col("event_id")
    ts = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60).cast("long"))
    return e.select(
        F.col("event_type").alias("model"), n.alias("call"), ts.alias("ts"), (n % 5 * 400 + 200).alias("need"), F.when(n % 3 == 0, n % 5 * 350 + 100).alias("used"),
        F.when(F.col("event_type") != "view", F.lit(4000).cast("long")).alias("budget"), F.when(n % 40 == 7, F.lit(45.0)).alias("retry_after"),
    )


def budget_decisions(spark: SparkSession, d: str) -> DataFrame:
    return bu.decisions(calls_of(spark, d))


def budget_patient(spark: SparkSession, d: str) -> DataFrame:
    """The same for a caller that waits for its minute's budget."""
    return bu.decisions(calls_of(spark, d), patient=True)


def budget_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same calls as a stream that is fed in three parts and restarted for each: the rows of budget_decisions."""
    at = made_once(spark, "budget", [f"{d}/events.parquet"], lambda path: replay(calls_of(spark, d), path))
    return spark.read.schema(bu.DECISIONS).parquet(f"{at}/out").where("model <> '~'")


@contextmanager
def state(spark: SparkSession, keys: int) -> Iterator[None]:
    """Streams that start in it keep their state in RocksDB, whatever the session names, in no more stores than keys."""
    settings = {STORE: ROCKS, PARTS: str(min(int(spark.conf.get(PARTS)), keys))}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def replay(calls: DataFrame, at: str) -> None:
    spark, columns = calls.sparkSession, [c.split()[0] for c in CALLS.split(", ")]
    cuts = [0.0, *(calls.select(F.col("ts").cast("double").alias("t")).approxQuantile("t", [1 / 3, 2 / 3], 0.01) or [0.0, 0.0]), 1e18]
    last = calls.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts"))  # moves the watermark past all others
    models = calls.select("model").distinct().count()
    nulls = [F.lit(None).cast(t).alias(c) for c, t in (("used", "long"), ("budget", "long"), ("retry_after", "double"))]
    last = last.select(F.lit("~").alias("model"), F.lit(-1).cast("long").alias("call"), "ts", F.lit(0).cast("long").alias("need"), *nulls)
    at_time = F.col("ts").cast("double")
    parts = [calls.where((at_time >= low) & (at_time < high)) for low, high in zip(cuts, cuts[1:])]
    for part in [*parts[:2], parts[2].unionByName(last)]:
        part.select(*columns).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = bu.decision_stream(spark.readStream.schema(CALLS).parquet(f"{at}/in"))
        with state(spark, models + 1):
            stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start(f"{at}/out").awaitTermination()


QUERIES = {"budget_decisions": (budget_decisions, None), "budget_patient": (budget_patient, None), "budget_stream": (budget_stream, None)}
