"""Boundaries of the verdicts, scores and cleaning rules."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bidsmith.config import DEFAULT, Config
from bidsmith.functions import cleaning as C
from bidsmith.functions import scoring
from bidsmith.operators import filters, rows
from bidsmith.schemas import TRAINING


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v) if v is not None else F.lit(None).cast("string"))
    return df.select(column.alias("x")).first()[0]


TRAINING_NAMES = [p.split()[0] for p in TRAINING.split(", ")]
GOOD = dict(award_amount="2000000", ticker="T", ticker_confidence="high", historical_market_cap_approx="1000000000", posted_date="2024-03-10", first_8k_date="", last_dilutive_filing_date="", first_pr_date="", has_pr="", agency_prior_win_count="")


def verdict(spark, **change):
    row = {**dict.fromkeys(TRAINING_NAMES), **GOOD, **change}
    return filters.training_verdict(spark.createDataFrame([tuple(row[n] for n in TRAINING_NAMES)], TRAINING)).first()


@pytest.mark.parametrize(
    ("change", "passed"),
    [
        ({"award_amount": "999999.99"}, False), ({"award_amount": "1000000"}, True),
        *(({"ticker_confidence": c}, ok) for c, ok in [("none", False), ("low", False), ("medium", True), ("medium_high", True), ("high", True), ("very_high", False), ("", False), ("None", False)]),
        *(({"historical_market_cap_approx": c}, ok) for c, ok in [("", False), ("None", False), ("0", False), ("5000000000", True), ("5000000001", False)]),
        *(({"first_8k_date": d}, ok) for d, ok in [("2024-03-09", True), ("2024-03-10", False), ("2024-03-12", False), ("2024-03-13", True), ("3/11/2024", True), ("nan", True)]),
        *(({"last_dilutive_filing_date": d}, ok) for d, ok in [("2024-03-11", True), ("2024-03-10", False), ("2024-01-10", False), ("2024-01-09", True)]),
    ],
)
def test_training_boundaries(spark, change, passed):
    assert verdict(spark, **change).passed is passed


@pytest.mark.parametrize(("has_pr", "date", "want"), [("unknown", "2024-03-10", None), ("nan", "2024-03-10", None), (None, "2024-03-10", None), ("True", "2024-03-10", True), ("True", "2024-03-12", True), ("True", "2024-03-13", False), ("True", "2024-03-09", False), ("True", "", None)])
def test_press_state(spark, has_pr, date, want):
    assert verdict(spark, has_pr=has_pr, first_pr_date=date).has_press is want


def test_prior_wins(spark):
    assert [verdict(spark, agency_prior_win_count=w).prior_wins for w in ("", "None", "3", "3.7", "x")] == [0, 0, 3, 3, 0]


def test_first_failing_rule_gives_the_reason(spark):
    rows_ = [(True, 5e5, "A", None, True, True, True), (False, 5e5, "A", None, True, True, True), (False, 1e6, "A", None, True, True, True), (False, 1e6, "A", 5e9, True, True, True), (False, 1e6, "A", 6e9, False, False, False), (False, 1e6, "A", 5e9, False, True, True), (False, 1e6, "A", 5e9, False, False, True), (False, 1e6, "A", 5e9, False, False, False)]
    df = spark.createDataFrame(rows_, "is_idiq boolean, award_amount double, awardee_name string, market_cap double, recent_8k boolean, has_press boolean, dilutive boolean")
    starts = [r.reason and r.reason[:12] for r in filters.live_verdict(df, DEFAULT).collect()]
    assert starts == ["IDIQ contrac", "Contract val", "Could not de", "Recent 8-K f", "Market cap $", "Press releas", "Dilutive equ", None]


def test_ratio_steps(spark):
    df = spark.createDataFrame([(a, 1e6) for a in (1e5, 99999.0, 5e4, 2e4, 1e4, 9900.0)] + [(1e6, 0.0), (1e6, None)], "a double, m double")
    assert [r[0] for r in df.select(scoring.ratio_points(F.col("a"), F.col("m"))).collect()] == [30, 20, 20, 12, 6, 2, 0, 0]


def test_sector_press_agency(spark):
    codes = ["336411", "541715", "336412", "33641X", "111111", "", None]
    assert [r[0] for r in spark.createDataFrame([(c,) for c in codes], "c string").select(scoring.sector_points(F.col("c"))).collect()] == [15, 15, 7, 7, 0, 0, 0]
    flags = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert [r[0] for r in flags.select(scoring.press_points(F.col("b"))).collect()] == [0, 15, 0]
    assert [r[0] for r in flags.select(scoring.agency_points(F.col("b"), F.lit(False))).collect()] == [15, 0, 15]
    assert [r[0] for r in flags.select(scoring.agency_points(F.col("b"))).collect()] == [15, 0, 0]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("DATASOFT TECHNOLOGIES INC 34 PARKWAY COMMONS WAY GREER SC USA 29650-5213", "DATASOFT TECHNOLOGIES INC"), ("ACME 34 MAIN ST", "ACME 34 MAIN ST"), ("LONG COMPANY PO BOX 5", "LONG COMPANY"), ("SHORT STE 5", "SHORT STE 5"), ("", ""), (None, ""), ("  PLAIN NAME  ", "PLAIN NAME")],
)
def test_clean_name(spark, raw, clean):
    assert one(spark, C.clean_name("n"), n=raw) == clean


def test_money_dates_and_identifiers(spark):
    assert [one(spark, C.money("v"), v=v) for v in ("$1,234.50", "7", "abc", None, "nan")] == [1234.5, 7.0, 0.0, 0.0, 0.0]
    assert [one(spark, C.signed_days("a", "b"), a=a, b="2024-01-05") for a in ("2024-01-01", "2024-01-01 10:00:00", "1/1/2024", "nan", None)] == [4, 4, None, None, None]
    assert [one(spark, C.iso_text("v"), v=v) for v in ("3/5/2024", "2024-03-05T01")] == ["2024-03-05", "2024-03-05"]
    assert one(spark, C.us_date("v"), v="2024-03-05") == "03/05/2024"
    assert [one(spark, C.padded("v"), v=v) for v in ("12", "12345678901")] == ["0000000012", "12345678901"]
    assert [one(spark, C.is_cage("v"), v=v) for v in ("12345", "abcde", "123", "123456", "", None)] == [True, True, False, False, False, False]
    assert [one(spark, C.is_lei("v"), v="A" * n) for n in (19, 20, 21)] == [False, True, False]
    assert one(spark, C.mail_date("v"), v="Tue, 05 Mar 2024 14:30:00 EST") == dt.datetime(2024, 3, 5, 14, 30)
    assert one(spark, C.bare_line("v"), v="2024-01-01 10:00:00 [ERROR] failed") == "failed"


def test_weekdays_after(spark):
    assert one(spark, C.weekdays_after(F.to_date("v"), 4), v="2024-03-01") == dt.date(2024, 3, 7)
    assert one(spark, C.weekdays_after(F.to_date("v"), 1), v="2024-03-02") == dt.date(2024, 3, 4)


def test_date_chunks(spark):
    df = spark.createDataFrame([(1, dt.date(2023, 1, 1), dt.date(2023, 1, 16)), (2, dt.date(2023, 1, 1), dt.date(2023, 1, 1)), (3, dt.date(2023, 1, 1), dt.date(2023, 2, 1))], "i int, a date, b date")
    got = [(r.i, r.chunk_start.day, r.chunk_end) for r in rows.date_chunks(df, "a", "b").orderBy("i", "chunk_start").collect()]
    assert got == [(1, 1, dt.date(2023, 1, 15)), (3, 1, dt.date(2023, 1, 15)), (3, 16, dt.date(2023, 1, 30)), (3, 31, dt.date(2023, 2, 1))]


def test_bulk_scan_bounds(spark):
    data = [("USA", "", 1e6), (" usa ", None, 1e10), ("GBR", "", 5e6), (None, "", 5e6), ("USA", "IDC", 5e6), ("USA", "", 5e5), ("USA", "", 1.5e10), ("USA", "", None)]
    df = spark.createDataFrame(data, "country_of_incorporation string, idv_type string, award_amount double")
    assert filters.bulk_scan(df, Config()).count() == 2
