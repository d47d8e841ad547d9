"""Stateful streams: admission by trailing hour and day, and the token ledger of a minute.

Admission depends on what was admitted before, so it is a fold over a key's requests in time order: the same fold runs
in batch over sorted groups and in a stream over state.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.service import HEADROOM, LEDGER_SECONDS, PER_DAY, PER_HOUR

HOUR = 3600


def admit(times: list[float], taken: list[float], limit: int) -> tuple[list[bool], list[float]]:
    """Which requests, in time order, are admitted by a trailing hour, and the admitted times that still matter. A
    request exactly an hour old still counts; refused ones never do."""
    verdicts = []
    for t in times:
        taken = [x for x in taken if t - x <= HOUR]
        ok = len(taken) < limit
        if ok:
            taken.append(t)
        verdicts.append(ok)
    return verdicts, taken


def admission_batch(requests: DataFrame, key: str, request: str, ts: str, limit: int = PER_HOUR) -> DataFrame:
    """(key, request, admitted) over bounded input; a key's requests go to one task, a column of times and ids."""
    schema = f"{key} {requests.schema[key].dataType.simpleString()}, {request} {requests.schema[request].dataType.simpleString()}, admitted boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", request], kind="stable")
        verdicts, _ = admit(pdf["t"].tolist(), [], limit)
        return pdf[[key, request]].assign(admitted=verdicts)

    return requests.select(key, request, F.unix_micros(F.col(ts).cast("timestamp")).alias("u")).withColumn("t", F.col("u") / 1e6).drop("u").groupBy(key).applyInPandas(run, schema)


class Admission(StatefulProcessor):
    """Input rows (key, request, t); output (key, request, admitted). State: the admitted times of the last hour."""

    def __init__(self, limit: int = PER_HOUR):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getListState("taken", "t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["t", "request"], kind="stable")
        verdicts, taken = admit(pdf["t"].tolist(), [x[0] for x in self.taken.get()], self.limit)
        self.taken.put([(float(t),) for t in taken]) if taken else self.taken.clear()
        yield pd.DataFrame({"key": [key[0]] * len(pdf), "request": pdf["request"].tolist(), "admitted": verdicts})

    def close(self) -> None:
        pass


def admission_stream(requests: DataFrame, limit: int = PER_HOUR) -> DataFrame:
    """The streaming form; requests: key string, request long, t double (seconds). Needs the RocksDB state store."""
    return requests.groupBy("key").transformWithStateInPandas(Admission(limit), "key string, request long, admitted boolean", "append", "none")


@dataclass
class Ledger:
    """The last minute of a model's charges, in the order of their times, waits included. Charges that the newest call has
    to see leave are gone already: only the last of them counts, as a later call waits for it too until its minute is
    over. So what is held never exceeds the budget, however long the queue."""

    most: int
    held: deque[tuple[float, int]] = field(default_factory=deque)
    used: int = 0
    gone: float = -math.inf

    def charge(self, t: float, tokens: int) -> tuple[float, bool]:
        """(wait in seconds, sent) of the next call, in time order; tokens is not negative."""
        if tokens > self.most:
            return 0.0, False
        wait = 0.0
        if t - self.gone < LEDGER_SECONDS:
            wait = self.gone + LEDGER_SECONDS - t
        else:
            while self.held and not t - self.held[0][0] < LEDGER_SECONDS:
                self.used -= self.held.popleft()[1]
        while self.used + tokens > self.most:
            self.gone, n = self.held.popleft()
            self.used -= n
            wait = self.gone + LEDGER_SECONDS - t
        self.held.append((t + wait, tokens))
        self.used += tokens
        return wait, True


def ledger(calls: list[tuple[float, int]], per_minute: int) -> list[tuple[float, bool]]:
    """(wait in seconds, sent) of calls (time, tokens) against a budget of a trailing minute with head room. An entry
    exactly a minute old has left; a call above the whole budget is never sent."""
    held = Ledger(int(per_minute * HEADROOM))
    return [held.charge(t, tokens) for t, tokens in calls]


def ledger_batch(calls: DataFrame, key: str, order: str, ts: str, tokens: str, per_minute: int) -> DataFrame:
    """(key, order, wait_s, sent) for each call of a model: its calls stream through one task in time order, of which no
    more than a minute's budget is held. Calls without a known size or with a negative one count as none."""
    schema = f"{key} {calls.schema[key].dataType.simpleString()}, {order} {calls.schema[order].dataType.simpleString()}, wait_s double, sent boolean"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = object(), None
        for batch in batches:
            out = []
            for of, t, n in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if held is None or of != name:
                    name, held = of, Ledger(int(per_minute * HEADROOM))
                wait, sent = held.charge(math.nan if t is None else t, n)
                out.append((round(wait, 6), sent))
            waits, sent = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(waits, pa.float64()), pa.array(sent, pa.bool_())], schema=arrow)

    t = (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t")
    timed = calls.select(F.col(key), F.col(order), t, F.greatest(F.lit(0), tokens).cast("long").alias("n"))
    return timed.repartition(key).sortWithinPartitions(key, F.asc_nulls_last("t"), F.asc_nulls_last(order)).mapInArrow(run, schema)


def day_quota(events: DataFrame, ts: str, cost, limit: int = PER_DAY) -> DataFrame:
    """(day, used, over): cost by UTC day."""
    days = events.groupBy(F.to_date(F.col(ts)).alias("day")).agg(F.sum(cost).cast("long").alias("used"))
    return days.withColumn("over", F.col("used") > limit)
