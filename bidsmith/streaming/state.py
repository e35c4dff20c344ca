"""Streams: deduplication, expiring state, positions, log lines and window counts.

All take a streaming DataFrame and return one; `drained` runs a stream over what its source holds
and returns the rows, checkpointing in the shared folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def live(cache: DataFrame, now: Column | float, expires: str = "expires_at") -> DataFrame:
    """Entries that haven't expired; an entry whose time is now has, one without a time never does."""
    return cache.where(F.col(expires).isNull() | (F.col(expires) > now))


def expired(cache: DataFrame, now: Column | float, expires: str = "expires_at") -> DataFrame:
    return cache.where(F.col(expires) <= now)


def shared(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset: a local one in local mode, an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{tempfile.gettempdir()}/bidsmith-streams"
    return f"{root.rstrip('/')}/bidsmith-stream/{name}-{uuid.uuid4().hex}"


def drained(stream: DataFrame, name: str, mode: str = "append", to: str | None = None, once: bool = False) -> DataFrame:
    """Run the stream until its source is read, then return its rows (of the last batch in complete mode).

    to: the folder for its rows (`out`) and its `checkpoint`, a new one by default. once: one batch only, for state that goes by
    the clock, whose stream never comes to rest.
    """
    spark, to = stream.sparkSession, to or shared(stream.sparkSession, name)

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{to}/out" if mode == "complete" else f"{to}/out/batch={batch}")

    put(spark.createDataFrame([], stream.schema), -1)  # a source without rows gives none, not an error
    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{to}/checkpoint").trigger(**({"once": True} if once else {"availableNow": True})).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{to}/out").select(*stream.columns)


def table_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream of a parquet file or folder: the schema is read once, files arrive `files` at a time."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", name if name.endswith(".parquet") else "*").option("recursiveFileLookup", "true").parquet(folder if name.endswith(".parquet") else path)


def staged(rows: DataFrame, at: str, to: str, days: int = 4, files: int = 8) -> DataFrame:
    """A stream of rows in the order of the time `at`, about so many days a batch: files are written period by period.

    Within a period files come in any order, so what follows needs a delay of more than `days`. Small periods come several at a time.
    """
    spark, period = rows.sparkSession, F.floor(F.unix_date(F.to_date(at)) / days).alias("_period")
    rows.select("*", period).write.partitionBy("_period").parquet(f"{to}-all")
    every = spark.read.parquet(f"{to}-all")
    for r in every.select("_period").distinct().orderBy("_period").collect():  # a row a period: bounded by time
        every.where(F.col("_period").eqNullSafe(F.lit(r[0]))).select(*rows.columns).coalesce(files).write.mode("append").parquet(to)
    return table_stream(spark, to, files)


def first_seen(stream: DataFrame, keys: list[str], at: str | None = None, delay: str = "30 days") -> DataFrame:
    """Each key once. With `at`, state older than the delay is dropped, so it stays bounded."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys) if at else stream.dropDuplicates(keys)


def window_counts(stream: DataFrame, at: str, keys: list[str], size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    window = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.withWatermark(at, delay).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def running_counts(stream: DataFrame, key: str) -> DataFrame:
    return stream.groupBy(key).agg(F.count("*").alias("n"))


def sorted_rows(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(by, kind="stable")


def changes(stream: DataFrame, key: str, order: list[str], line: str, at: str | None = None, delay: str = "30 days") -> DataFrame:
    """Rows whose line differs from the last one of their key, across batches; state is one line a key.

    With `at`, a time, a key that has been silent for longer than `delay` is forgotten, so state stays bounded; without, it is kept for ever.
    """
    schema = stream.schema

    def step(name, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        last, kept = state.get[0] if state.exists else None, []
        pdf = sorted_rows(frames, order)
        for place, value in zip(pdf.index, pdf[line], strict=True):
            if last is None or value != last:
                kept.append(place)
            last = value
        state.update((last,))
        if at:  # the watermark is `delay` behind the latest event already
            state.setTimeoutTimestamp(max(_millis(pdf[at].max(), zone), state.getCurrentWatermarkMs() + 1))
        yield pdf.loc[kept]

    zone = stream.sparkSession.conf.get("spark.sql.session.timeZone")
    timed = stream.withWatermark(at, delay) if at else stream
    return timed.groupBy(key).applyInPandasWithState(step, schema, "last string", "append", "EventTimeTimeout" if at else "NoTimeout")


def _millis(when: pd.Timestamp, zone: str) -> int:
    """Milliseconds since 1970, rounded up, of a time as Arrow gives it: without a zone, in the session's."""
    return -(-when.tz_localize(zone, ambiguous=False, nonexistent="shift_forward").value // 1_000_000)


def cached(stream: DataFrame, key: str, at: str, value: str, days: float, delay: str = "30 days") -> DataFrame:
    """Lookups through an expiring memo by event time: each row with `hit` and the value the memo gives.

    A miss stores the row's own value for `days`; a stored one is given until its time is up. State goes when the
    watermark has passed that time; rows later than `delay` are dropped.
    """
    out = f"{key} {stream.schema[key].dataType.simpleString()}, {at} timestamp, hit boolean, given {stream.schema[value].dataType.simpleString()}"
    kept = f"given {stream.schema[value].dataType.simpleString()}, until timestamp"
    zone = stream.sparkSession.conf.get("spark.sql.session.timeZone")

    def step(name, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        given, until = state.get if state.exists else (None, None)
        until = pd.Timestamp(until) if until is not None else None
        rows = []
        for when, own in sorted_rows(frames, [at, value])[[at, value]].itertuples(index=False):
            hit = until is not None and when < until
            if not hit:
                given, until = own, when + pd.Timedelta(days=days)
            rows.append((name[0], when, hit, given))
        if _millis(until, zone) > state.getCurrentWatermarkMs():
            state.update((given, until.to_pydatetime()))
            state.setTimeoutTimestamp(_millis(until, zone))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=[key, at, "hit", "given"])

    return stream.withWatermark(at, delay).groupBy(key).applyInPandasWithState(step, out, kept, "append", "EventTimeTimeout")


def positions(stream: DataFrame, key: str, at: str, kind: str, price: str, opens: str, closes: str, hold_days: int, delay: str = "30 days") -> DataFrame:
    """A position a key: opened by `opens`, closed by `closes` (closed_auto) or when its time is up (closed_time), at the last price until then.

    Time is up at the next event past it or, on a quiet key, when the watermark (the latest event less `delay`) has
    passed it: either gives the same row. State is one open position a key; rows later than `delay` are dropped.
    Gives one row a closed position: opened, closed, status, entry, exit and gain.
    """
    out = f"{key} {stream.schema[key].dataType.simpleString()}, opened timestamp, closed timestamp, status string, entry double, exit double, pnl double"
    zone = stream.sparkSession.conf.get("spark.sql.session.timeZone")

    def step(name, frames, state):
        opened, entry, seen = state.get if state.exists else (None, None, None)
        opened = pd.Timestamp(opened) if opened is not None else None
        rows = []

        def close(when, status, paid):
            rows.append((name[0], opened, when, status, entry, paid, round(paid - entry, 2)))

        held = pd.Timedelta(days=hold_days)
        if not state.hasTimedOut:
            for when, what, paid in sorted_rows(frames, [at, kind, price])[[at, kind, price]].itertuples(index=False):
                if opened is not None and when >= opened + held:
                    close(opened + held, "closed_time", seen)
                    opened = None
                elif opened is not None and what == closes:
                    close(when, "closed_auto", float(paid))
                    opened = None
                if opened is None and what == opens:
                    opened, entry = when, float(paid)
                seen = float(paid)
        if opened is not None and _millis(opened + held, zone) <= state.getCurrentWatermarkMs():
            close(opened + held, "closed_time", seen)
            opened = None
        if opened is not None:
            state.update((opened.to_pydatetime(), entry, seen))
            state.setTimeoutTimestamp(_millis(opened + held, zone))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=[key, "opened", "closed", "status", "entry", "exit", "pnl"])

    return stream.withWatermark(at, delay).groupBy(key).applyInPandasWithState(step, out, "opened timestamp, entry double, seen double", "append", "EventTimeTimeout")
