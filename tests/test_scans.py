"""Lines in any character set by byte ranges, feeds as XML, guards of failed lookups, enrichment that is stopped."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from bidsmith.operators import trades
from bidsmith.sources import lines, readers
from bidsmith.streaming import state as S
from bidsmith.streaming.enrich import enriched

TEXTS = ["Ärger und Öl", "", "plain", "ĀĊਊഊ letters with line feeds in their bytes", "last", "日本" * 50]


@pytest.mark.parametrize(("encoding", "mark"), [("utf-8", b"\xef\xbb\xbf"), ("utf-16", b"\xff\xfe"), ("utf-16-le", b""), ("utf-16-be", b""), ("utf-16", b"\xfe\xff"), ("cp1252", b"")])
@pytest.mark.parametrize("feed", ["\n", "\r\n"])
def test_lines_by_byte_ranges(spark, tmp_path, encoding, mark, feed):
    own = [t for t in TEXTS if encoding != "cp1252" or t.isascii() or "Ä" in t] * 7
    name = {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}.get(mark, encoding)
    (tmp_path / "x.txt").write_bytes(mark + feed.join(own).encode(name))
    for split in (2, 17, 64, 1 << 20):
        got = lines.byte_lines(spark, str(tmp_path), encoding, split).orderBy("file", "split", "at").collect() if split > 16 or encoding == "utf-8" else None
        assert got is None or [r.line for r in got] == own
    if encoding == "utf-8":
        with pytest.raises(Exception, match="none.txt"):
            lines.byte_lines(spark, str(tmp_path / "none.txt")).collect()


def test_bad_bytes_and_report_in_latin(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"a\xffb\nok")
    assert [r.line for r in lines.byte_lines(spark, f"file://{tmp_path}/a.txt").orderBy("at").collect()] == ["a�b", "ok"]
    (tmp_path / "r.csv").write_bytes('preamble\nCAGE Code,PIID,Contractor Name\n1,P1,"Señor\nÖl"\n2,P2,Ürün\n'.encode("iso-8859-1"))
    got = readers.report_csv(spark, str(tmp_path / "r.csv"), "iso-8859-1", 20).collect()
    assert sorted((r.piid, r.contractor_name) for r in got) == [("P1", "Señor\nÖl"), ("P2", "Ürün")]


def test_feed_items_as_xml(spark):
    date = "Tue, 05 Mar 2024 14:30:00 GMT"
    feed = f"<rss xmlns:x='u'><item a='1'><title>A &amp; B &lt;c&gt;</title><x:y>z</x:y><pubDate>{date}</pubDate></item>\n<item><title><![CDATA[<b>raw</b> & more]]></title></item><item><title>open<pubDate>{date}</pubDate></item><items>no</items></rss>"
    rows = readers.feed_items(spark.createDataFrame([(1, feed), (2, None), (3, "<rss/>")], "i int, x string"), "x", "i").collect()
    assert [(r.i, r.title, r.published) for r in rows] == [(1, "A & B <c>", dt.datetime(2024, 3, 5, 14, 30)), (1, "<b>raw</b> & more", None), (1, None, None)]
    day = spark.createDataFrame([(1, feed.replace("z<", "PRNewswire<"))], "i int, x string")
    items = lambda at: readers.feed_items(day, "x", "i").withColumn("at", F.to_date(F.lit(at)))
    assert readers.first_press(items("2024-03-04"), "i", "at", 2).collect()[0].first_pr == dt.date(2024, 3, 5)
    assert readers.first_press(items("2024-03-07"), "i", "at", 2).collect()[0].first_pr is None


def test_guards(spark):
    signals = spark.createDataFrame([(t,) for t in "abcde"], "ticker string")
    held = spark.createDataFrame([("a", "open"), ("a", "failed"), ("b", "failed"), ("c", "closed")], "ticker string, status string")
    orders = spark.createDataFrame([("b", "open"), ("c", "open"), ("d", "failed")], "ticker string, status string")
    got = {r.ticker: r.guard for r in trades.guarded(signals, held, orders).collect()}
    assert got == {"a": "position already open", "b": "position lookup failed", "c": "open order already exists", "d": None, "e": None}
    assert {r.ticker for r in trades.not_held(signals, held, orders).collect()} == {"d", "e"}


def test_enrichment_goes_on_where_it_stopped(spark, tmp_path):
    folder, asked = str(tmp_path / "in"), []
    for k in range(4):
        rows = [(str(10 * k + i), "T" if i else "", "1.0" if i == 3 else "") for i in range(5)]
        spark.createDataFrame(rows, "ident string, ticker string, open_t0 string").coalesce(1).write.mode("append").parquet(folder)

    def enrich(df, limit=99):
        ids = sorted(r.ident for r in df.collect())
        if len(asked) >= limit:
            raise RuntimeError("stopped")
        asked.append(ids)
        return df.withColumn("open_t0", F.concat(F.lit("v"), "ident")).withColumn("close_t0", F.lit("x"))

    run = lambda f: enriched(S.table_stream(spark, folder), f, "open_t0", ["ticker"], str(tmp_path / "out"), str(tmp_path / "mark"))
    with pytest.raises(StreamingQueryException):
        run(lambda df: enrich(df, 2))
    assert len(asked) == 2
    run(enrich)
    run(enrich)
    assert [len(a) for a in asked] == [3] * 4 and len({i for a in asked for i in a}) == 12
    got = spark.read.schema("ident string, ticker string, open_t0 string, close_t0 string").parquet(str(tmp_path / "out")).collect()
    want = {str(10 * k + i): "" if i == 0 else "1.0" if i == 3 else f"v{10 * k + i}" for k in range(4) for i in range(5)}
    assert {r.ident: r.open_t0 for r in got} == want and len(got) == 20


def test_busy_service_is_paged_side_by_side(spark, sf_dir):
    """Pauses between a task's requests add up over its own pages only."""
    from bidsmith import catalog

    df = catalog.QUERIES["busy_scan"](spark, sf_dir)
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    assert df.select("event_id").distinct().count() == df.count() > 0


def test_ranges_of_a_report_are_read_once(spark, tmp_path):
    """However many steps go through the lines, Python reads each range once; the rows are those of the file."""
    from bidsmith.sources import readers

    rows = [f'"{i}","0AB12","a ""b"" Ñ{i}{chr(10) if i % 7 == 0 else ""}x"' for i in range(300)]
    (tmp_path / "r.csv").write_bytes("\n".join(["a report", "PIID,CAGE Code,Contractor Name", *rows]).encode("latin-1"))
    df = readers.report_csv(spark, str(tmp_path / "r.csv"), "iso-8859-1", 512)
    assert "byte_lines" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.piid: r.contractor_name for r in df.select("piid", "contractor_name").collect()}
    assert got == {str(i): f'a "b" Ñ{i}{chr(10) if i % 7 == 0 else ""}x' for i in range(300)}
