"""Readers and writers on small files."""

from __future__ import annotations

import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from bidsmith.operators.filters import bulk_scan
from bidsmith.schemas import REPORT_FIELDS, REPORT_FLAGS
from bidsmith.sources import paged, readers, sinks

BASE = {"CAGE Code": "7QZ31", "Unique Entity ID": "QWERTY778899", "Contractor Name": "NORTH HARBOR OPTICS LLC", "Country of Incorporation": "USA", "Base and All Options Value (Total Contract Value)": "2750000.50", "Period of Performance Start Date": "2021-11-08", "IDV Type": "", "PIID": "P-17"}
HEADERS = [*REPORT_FIELDS, *(f"Is Vendor Business Type - {h}" for h in REPORT_FLAGS)]


def report(path, rows, preamble=(), bom=False, header=True):
    quote = lambda v: '"' + v.replace('"', '""') + '"'
    lines = [*preamble, *([",".join(map(quote, HEADERS))] if header else []), *(",".join(quote({**BASE, **r}.get(h, "")) for h in HEADERS) for r in rows)]
    path.write_bytes((b"\xef\xbb\xbf" if bom else b"") + "\r\n".join(lines).encode())
    return str(path)


def test_report(spark, tmp_path):
    path = report(tmp_path / "a.csv", [{}, {"PIID": "P-18", "Country of Incorporation": "CAN"}, {"PIID": "P-19", "IDV Type": "IDC"}, {"PIID": "P-20", "Base and All Options Value (Total Contract Value)": "$2,750,000"}, {"PIID": "P-21", "Base and All Options Value (Total Contract Value)": "N/A"}])
    df = readers.report_csv(spark, path)
    assert df.count() == 5
    assert sorted(r.piid for r in bulk_scan(df).collect()) == ["P-17", "P-20"]
    assert df.where("piid = 'P-17'").first().posted_date == "2021-11-08"


def test_report_preamble_bom_newline(spark, tmp_path):
    path = report(tmp_path / "a.csv", [{"Contractor Name": "TWO\r\nLINES, INC", f"Is Vendor Business Type - {next(iter(REPORT_FLAGS))}": "Yes"}], ["Quarterly extract", "", "an \"unfinished quotation", "made by hand", ""], bom=True)
    row = readers.report_csv(spark, path).first()
    assert row.contractor_name == "TWO\nLINES, INC"
    assert row.is_educational is True
    assert row.is_federal_agency is False


def test_report_without_header_or_file(spark, tmp_path):
    assert readers.report_csv(spark, report(tmp_path / "b.csv", [{}], header=False)).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.report_csv(spark, str(tmp_path / "none.csv")).count()


def test_large_report_in_splits(spark, tmp_path):
    """100,000 records, many over several lines, in many splits: each is whole, and none is lost."""
    path = report(tmp_path / "big.csv", [{"PIID": f"N{i}", "Contractor Name": f'A "{i}"\r\n\r\nB, {i}' if i % 7 == 0 else f"C {i}"} for i in range(100_000)], ["first", "second"])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000000")
    try:
        rows = readers.report_csv(spark, path).select("piid", "contractor_name").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r.piid: r.contractor_name for r in rows} == {f"N{i}": f'A "{i}"\n\nB, {i}' if i % 7 == 0 else f"C {i}" for i in range(100_000)}
    assert len(rows) == 100_000


def test_newest_report(spark, tmp_path):
    for i, n in enumerate(("x_Report_1.csv", "SAM_2.csv", "other.csv", "deeper/z_Report_3.csv")):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("a")
        os.utime(tmp_path / n, (time.time() + i, time.time() + i))
    (tmp_path / "a_Report.csv").mkdir()
    assert readers.newest_report(spark, str(tmp_path)).endswith("SAM_2.csv")
    empty = tmp_path / "empty" / "k=1"
    empty.mkdir(parents=True)
    (empty / "y_Report_4.csv").write_text("a")
    with pytest.raises(FileNotFoundError):
        readers.newest_report(spark, str(tmp_path / "empty"))


def test_lists_lines_and_urls(spark, tmp_path):
    listed = json.dumps({"0": {"cik_str": 5, "ticker": "AB", "title": "Alpha"}, "1": {"cik_str": 6, "ticker": "CD", "title": "Beta"}})
    rows = readers.company_list(spark.createDataFrame([(listed,)], "value string")).collect()
    assert [(r.company, r.ticker, r.cik) for r in rows] == [("Alpha", "AB", 5), ("Beta", "CD", 6)]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": \nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in readers.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]
    df = spark.createDataFrame([("a b&c", None)], "q string, r string").select(readers.search_url("http://x/y", q=F.col("q"), r=F.col("r"), n="3").alias("u"))
    assert df.first().u == "http://x/y?q=a+b%26c&n=3"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo\n")
    from bidsmith.streaming.state import drained

    assert sorted(r.value for r in drained(readers.line_stream(spark, str(tmp_path / "in")), "lines").collect()) == ["one", "two"]


def test_opportunities(spark):
    good = {"title": "Radar, sole source", "solicitationNumber": "S1", "postedDate": "2024-01-02", "award": {"amount": "$2,000,000", "awardee": {"name": "ACME RADAR INC 12 ELM ST"}}}
    df = spark.createDataFrame([(json.dumps(x),) for x in (good, {**good, "award": {"amount": "0", "awardee": {"name": "X"}}}, {"title": "no award"})], "value string")
    rows = readers.opportunities(df).collect()
    assert [(r.awardee_name, r.award_amount, r.sole_source, r.is_idiq) for r in rows] == [("ACME RADAR INC", 2e6, True, False)]


def test_feed_and_filings(spark):
    feed = "<rss><item><title>A</title><pubDate>Tue, 05 Mar 2024 14:30:00 GMT</pubDate></item><item><title>B</title></item></rss>"
    got = readers.feed_items(spark.createDataFrame([(1, feed)], "i int, x string"), "x", "i").orderBy("title").collect()
    assert [(r.title, r.published) for r in got] == [("A", dt.datetime(2024, 3, 5, 14, 30)), ("B", None)]
    df = spark.createDataFrame([(7, ["8-K", "S-1", "8-K"], ["2024-01-01", "2024-02-01", "2024-03-01"], ["x"])], "cik int, form array<string>, filed array<string>, description array<string>")
    assert [(r.form, r.filed) for r in readers.filings(df, "2024-01-15", ("8-K",)).collect()] == [("8-K", "2024-03-01")]


def pages(filters, page, size):
    """45 rows in order; only full pages but for the last."""
    rows = [(i, "x" if i % 2 else "y") for i in range(45)]
    rows = [r for r in rows if r[1] in filters.get("kind", ["x", "y"]) and r[0] >= filters.get("i >=", [0])[0]]
    if filters.get("order") == ["desc"]:
        rows = rows[::-1]
    return rows[page * size : page * size + size]


def test_paged_source(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(paged.PagedSource)
    read = lambda **more: spark.read.format("paged").options(fetch="tests.test_sources:pages", schema="i bigint, kind string", size="10", **more).load()
    assert read().count() == 45
    assert read(lanes="3").where("kind = 'x'").count() == 22
    assert read(pause="0.01").where("i >= 30").count() == 15
    assert [r.i for r in read(most="13", order="desc").collect()] == list(range(44, 31, -1))


def test_retry():
    waits, answers = [], iter([None, None, [1]])
    assert paged.retried(lambda: next(answers), wait=waits.append) == [1]
    assert waits == [10.0, 20.0]
    with pytest.raises(TimeoutError):
        paged.retried(lambda: None, wait=waits.append)


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([("T", 5, "extra")], "ticker string, score int, other string")
    sinks.append_signals(df, path)
    sinks.append_signals(df, path)
    back = readers.plain_csv(spark, path)
    assert back.count() == 2
    assert "other" not in back.columns
    sinks.write_snapshot(spark.createDataFrame([("A", 1.0)], "awardee_name string, award_amount double"), str(tmp_path), "2024-01-01", "2024-01-15")
    assert readers.snapshot(spark, str(tmp_path), "2024-01-01", "2024-01-15").first().awardee_name == "A"
    assert readers.snapshot(spark, str(tmp_path), "2024-02-01", "2024-01-15").count() == 0
    done, todo = sinks.resumed(spark.createDataFrame([("1", "T"), ("None", "T"), ("", ""), (None, "T")], "open_t0 string, ticker string"), "open_t0", ["ticker"])
    assert (done.count(), todo.count()) == (2, 2)


def test_publish_survives_a_crash(spark, tmp_path):
    """Folders that a crashed write left, of the next or of an old number, are in nobody's way."""
    path, schema = str(tmp_path / "table"), "k int"
    rows = lambda *k: spark.createDataFrame([(x,) for x in k], schema)
    sinks.publish(rows(1), path)
    for left in ("v2", "v2-feed", "v1-dead"):
        os.makedirs(f"{path}/{left}/_temporary")
        (tmp_path / "table" / left / "part-0.json").write_text('{"k": 99}\n')
    assert [r.k for r in sinks.published(spark, path, schema).collect()] == [1]
    sinks.publish(rows(2, 3), path)
    assert sorted(r.k for r in sinks.published(spark, path, schema).collect()) == [2, 3]
    sinks.publish(sinks.published(spark, path, schema).selectExpr("k + 10 as k"), path)
    assert sorted(r.k for r in sinks.published(spark, path, schema).collect()) == [12, 13]
    assert sorted(n.partition("-")[0] for n in os.listdir(path)) == ["v2", "v3"]
