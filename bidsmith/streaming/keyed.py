"""Keyed state with maps, time limits and timers, kept in RocksDB, and read as a table.

A service's memo is one state a service: a map from what was asked to the answer and the time it is good until. By event time,
a timer for each such time removes what is due when the watermark passes it; by the clock, the state store's own time to live does.
Either way the state holds live entries only, on executors' disks, and only the entries that a batch touches are read.
`memo_table` reads the state of a checkpoint as a table: what an eviction sweep leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bidsmith.streaming.state import _millis, sorted_rows

_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started within keep their state in RocksDB; the session's setting is as before afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


#: Parts of a service's memo: what is asked falls in one of them, so that a service is many tasks' work.
PARTS = 64


class Memo(StatefulProcessor):
    """Rows of a service: asked, at, answer. Each is a hit if a live entry answers it, else it puts its own answer in."""

    def __init__(self, service: str, asked: str, at: str, answer: str, kinds: tuple[str, str], days: float, zone: str, clock: bool):
        self.names, self.kinds, self.days, self.zone, self.clock = (service, asked, at, answer), kinds, days, zone, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the time to live runs by the clock; by event time, timers do its work
        self.entries = handle.getMapState("entries", f"asked {self.kinds[0]}", f"answer {self.kinds[1]}, until timestamp", ttlDurationMs=int(self.days * 86_400_000) if self.clock else None)
        self.due = None if self.clock else handle.getMapState("due", "at bigint", f"asked array<{self.kinds[0]}>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        service, asked, at, answer = self.names
        pdf, out, held, put, due = sorted_rows(rows, [at, asked, answer]), [], {}, {}, {}
        some = self.entries.exists()
        for what, when, own in pdf[[asked, at, answer]].itertuples(index=False):
            what = what.item() if hasattr(what, "item") else what
            if what not in held:
                held[what] = self.entries.getValue((what,)) if some and self.entries.containsKey((what,)) else None
            entry = held[what]
            hit = entry is not None and (self.clock or when < pd.Timestamp(entry[1]))
            if not hit:
                until = when + pd.Timedelta(days=self.days)
                entry = held[what] = put[what] = (own.item() if hasattr(own, "item") else own, until.to_pydatetime())
            out.append((key[0], what, when, hit, entry[0]))
        for what, entry in put.items():  # the last of a batch stays: those before it need no place and no timer
            self.entries.updateValue((what,), entry)
            due.setdefault(_millis(pd.Timestamp(entry[1]), self.zone), set()).add(what)
        timed = not self.clock and self.due.exists()
        for ms, new in due.items() if not self.clock else ():
            old = self.due.getValue((ms,))[0] if timed and self.due.containsKey((ms,)) else []
            self.due.updateValue((ms,), (sorted({*old, *new}),))
            self.handle.registerTimer(ms)
        yield pd.DataFrame(out, columns=[service, asked, at, "hit", "given"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for what in self.due.getValue((now,))[0]:
            if _millis(pd.Timestamp(self.entries.getValue((what,))[1]), self.zone) == now:  # not put in anew since
                self.entries.removeKey((what,))
        self.due.removeKey((now,))
        return iter(())

    def close(self) -> None:
        pass


def memoized(stream: DataFrame, service: str, asked: str, at: str, answer: str, days: float, delay: str = "30 days", clock: bool = False) -> DataFrame:
    """The stream's rows with `hit` and the answer `given`, through a memo that keeps answers for `days`.

    Entries go when the watermark (the latest event less `delay`) passes their time; clock: by the clock since they were put in.
    Start it within `rocksdb`.
    """
    kind = lambda c: stream.schema[c].dataType.simpleString()
    zone = stream.sparkSession.conf.get("spark.sql.session.timeZone")
    out = f"{service} {kind(service)}, {asked} {kind(asked)}, {at} timestamp, hit boolean, given {kind(answer)}"
    memo = Memo(service, asked, at, answer, (kind(asked), kind(answer)), days, zone, clock)
    timed = stream if clock else stream.withWatermark(at, delay)
    timed = timed.withColumn("_part", F.pmod(F.xxhash64(asked), F.lit(PARTS)).cast("int"))  # an answer depends on what is asked before of the same
    return timed.groupBy(service, "_part").transformWithStateInPandas(memo, out, "append", "processingTime" if clock else "eventTime")


def memo_table(spark: SparkSession, checkpoint: str, service: str, asked: str) -> DataFrame:
    """service, asked, answer and until of the entries that the memo of a checkpoint holds."""
    entries = spark.read.format("statestore").option("stateVarName", "entries").load(checkpoint)
    value = "user_map_value.value" if "ttlExpirationMs" in entries.schema["user_map_value"].dataType.names else "user_map_value"
    return entries.select(F.col(f"key.{service}").alias(service), F.col("user_map_key.asked").alias(asked), F.col(f"{value}.answer").alias("answer"), F.col(f"{value}.until").alias("until"))
