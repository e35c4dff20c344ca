"""The polled service: a broken run, started again, leaves the same ledger; windows and filters."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from bidsmith.sources import paged
from bidsmith.streaming.polling import ledger, poll

FETCH, SCHEMA = "bidsmith.sources.paged:folder_page", "ident bigint, posted string"
SINCE = "2024-03-01T00:00:00"


@pytest.fixture
def service(spark, tmp_path):
    rows = [(i, (dt.datetime(2024, 3, 1) + dt.timedelta(hours=i)).strftime("%Y-%m-%dT%H:%M:%S")) for i in range(200)]
    rows += [(7, rows[7][1]), (9, "2024-03-01T09:30:00")]  # a repeated record, and one that is filed again later
    df = spark.createDataFrame([(i, p, p if i % 10 else p[:11] + "23:59:59", p[:10]) for i, p in rows], "ident bigint, posted string, seen string, day string")
    df.repartition("day").write.partitionBy("day").parquet(str(tmp_path / "service"))
    return f"file://{tmp_path}/service"


def polled(spark, service, to, now, process=None, after=None):
    stream = paged.paged_stream(spark, FETCH, SCHEMA, SINCE, now=now, size=7, **{"filter.folder": service})
    poll(stream, ["ident"], "posted", f"{to}/ledger", f"{to}/mark", process, after).awaitTermination()
    return stream.schema


def rows(spark, to):
    return sorted(map(tuple, ledger(spark, f"{to}/ledger", paged.StructType.fromDDL(SCHEMA)).collect()))


NOWS = ("2024-03-02T10:00:00", "2024-03-05T00:30:00", "2024-03-08T12:00:00")


def test_ledger_has_each_record_once(spark, service, tmp_path):
    for now in NOWS:
        polled(spark, service, tmp_path / "a", now)
    got = rows(spark, tmp_path / "a")
    assert [r[0] for r in got] == [i for i in range(181) if i not in (170, 180)]  # these aren't seen yet, being late
    assert dict((r[0], r[1]) for r in got)[9] == "2024-03-01T09:00:00"


@pytest.mark.parametrize("broken", ["before", "behind"])
def test_broken_polls_are_run_again(spark, service, tmp_path, broken):
    """A crash before a batch's rows are in the ledger, or behind that but before its commit: the same rows as without."""
    to, seen = tmp_path / broken, []

    def fail(df, *_):
        raise RuntimeError("power cut")

    for now in NOWS:
        polled(spark, service, tmp_path / "whole", now)
    polled(spark, service, to, NOWS[0])
    checks = {"process": lambda df: df.select("*") if df.isStreaming else fail(df)} if broken == "before" else {"after": fail}
    with pytest.raises(StreamingQueryException):
        polled(spark, service, to, NOWS[1], **checks)
    for _ in range(2):  # the batch left open, then the next
        polled(spark, service, to, NOWS[2], after=lambda df, batch: seen.append((batch, df.count())))
    assert rows(spark, to) == rows(spark, tmp_path / "whole")
    assert [b for b, _ in seen] == [1, 2] and sum(n for _, n in seen) == sum(r[2] > 0 for r in rows(spark, to))


def test_windows():
    reader = paged.PolledReader({"since": SINCE, "back": "1", "now": "2024-03-03T00:20:00"})
    days = [p.day for p in reader.partitions({"until": "2024-03-02T00:30:00"}, reader.latestOffset())]
    assert days == ["2024-03-01", "2024-03-02", "2024-03-03"]
    assert reader.partitions(reader.latestOffset(), reader.latestOffset()) == []
    assert paged.PolledReader({"since": "2099-01-01T00:00:00"}).latestOffset() == {"until": "2099-01-01T00:00:00"}


def test_folder_filters(service):
    sent = {"folder": [service], "day": ["2024-03-02"], "ident >=": [30], "order": ["-ident"], "columns": ["ident"]}
    assert paged.folder_page(sent, 0, 5) == [(47,), (46,), (45,), (44,), (43,)]
    assert paged.folder_page({**sent, "ident": [31, 99]}, 0, 5) == [(31,)]
    assert paged.folder_page({**sent, "until": ["2024-03-02T08:00:00"]}, 0, 9) == [(32,), (31,)]
    assert paged.folder_page(sent, 4, 5) == []


def test_no_poll_no_ledger(spark, tmp_path):
    assert ledger(spark, f"{tmp_path}/none", paged.StructType.fromDDL(SCHEMA)).where(F.lit(True)).collect() == []
