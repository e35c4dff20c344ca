"""The memo in RocksDB: restarts, entries put in anew, eviction, and time to live by the clock."""

from __future__ import annotations

import datetime as dt

from bidsmith.streaming import keyed
from bidsmith.streaming import state as S

T = dt.datetime(2024, 5, 1)
SCHEMA = "service string, asked string, at timestamp, answer int"


def put(spark, folder, *rows):
    spark.createDataFrame([(s, a, T + dt.timedelta(hours=h), n) for s, a, h, n in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, to, **more):
    with keyed.rocksdb(spark):
        rows = S.drained(keyed.memoized(S.table_stream(spark, folder), "service", "asked", "at", "answer", 1, **more), "memo", to=to, once="clock" in more)
        left = keyed.memo_table(spark, f"{to}/checkpoint", "service", "asked").collect()
    return {(r.service, r.asked, int((r["at"] - T).total_seconds() / 3600)): (r.hit, r.given) for r in rows.collect()}, {(r.service, r.asked): (r.answer, int((r.until - T).total_seconds() / 3600)) for r in left}


def test_memo_goes_on_after_a_restart(spark, tmp_path):
    folder, to = str(tmp_path / "in"), str(tmp_path / "run")
    put(spark, folder, ("lei", "a", 0, 1), ("lei", "a", 5, 2), ("figi", "a", 6, 3), ("lei", "b", 7, 4), ("lei", "a", 24, 5))
    rows, left = run(spark, folder, to, delay="10 hours")
    assert rows == {("lei", "a", 0): (False, 1), ("lei", "a", 5): (True, 1), ("figi", "a", 6): (False, 3), ("lei", "b", 7): (False, 4), ("lei", "a", 24): (False, 5)}
    assert left == {("lei", "a"): (5, 48), ("lei", "b"): (4, 31), ("figi", "a"): (3, 30)}
    put(spark, folder, ("lei", "b", 26, 9), ("figi", "c", 41, 6))
    rows, left = run(spark, folder, to, delay="10 hours")
    assert rows["lei", "b", 26] == (True, 4)
    assert left == {("lei", "a"): (5, 48), ("figi", "c"): (6, 65)}  # the watermark, hour 31, has passed the others' time


def test_clock(spark, tmp_path):
    folder, to = str(tmp_path / "in"), str(tmp_path / "run")
    put(spark, folder, ("lei", "a", 0, 1), ("lei", "a", 100, 2))
    rows, left = run(spark, folder, to, clock=True)
    assert rows == {("lei", "a", 0): (False, 1), ("lei", "a", 100): (True, 1)}  # a day hasn't gone by
    assert set(left) == {("lei", "a")}


def test_setting_is_as_before(spark):
    before = spark.conf.get(keyed._PROVIDER, None)
    with keyed.rocksdb(spark):
        assert spark.conf.get(keyed._PROVIDER) == keyed._ROCKS
    assert spark.conf.get(keyed._PROVIDER, None) == before


def test_one_timer_for_what_a_batch_puts_in_anew(spark, tmp_path):
    """A service's memo is many keys, and of entries that one batch replaces only the last has a timer."""
    folder, to = str(tmp_path / "in"), str(tmp_path / "run")
    put(spark, folder, *(("lei", a, h, h) for a in "abcdefgh" for h in (0, 30, 60, 61)))
    rows, left = run(spark, folder, to, delay="90 days")
    assert {k[2]: v for k, v in rows.items() if k[1] == "a"} == {0: (False, 0), 30: (False, 30), 60: (False, 60), 61: (True, 60)}
    assert left == {("lei", a): (60, 84) for a in "abcdefgh"}
    due = spark.read.format("statestore").option("stateVarName", "due").load(f"{to}/checkpoint")
    assert {r.at for r in due.select("user_map_key.at").collect()} == {int((T + dt.timedelta(hours=84)).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)}
    assert due.select("key").distinct().count() > 1


def test_staged_streams_come_in_the_order_of_time(spark, tmp_path):
    """A stage is a few days, written after the one before it: a stream of it is no later than those days, and all rows come."""
    import glob
    import os

    from pyspark.sql import functions as F

    from bidsmith.streaming import state as S

    rows = spark.range(0, 400, 1, 7).select("id", (F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.xxhash64("id"), F.lit(40 * 86400)))).alias("at"))
    stream = S.staged(rows, "at", str(tmp_path / "in"), days=4, files=3)
    files = sorted(glob.glob(f"{tmp_path}/in/*.parquet"), key=os.path.getmtime)
    periods = [{r[0] for r in spark.read.parquet(f).select(F.floor(F.unix_date(F.to_date("at")) / 4)).distinct().collect()} for f in files]
    assert len(files) > 3 and all(len(p) == 1 for p in periods) and periods == sorted(periods, key=min)
    assert S.drained(stream.withWatermark("at", "5 days").dropDuplicatesWithinWatermark(["id"]), "staged").count() == 400
