"""The five-factor score as one struct of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidsmith.config import HOT_SECTORS, RATIO_REST, RATIO_STEPS, WEIGHTS, WIDE_POINTS, WIDE_SECTOR


def ratio_points(amount: Column, market_cap: Column) -> Column:
    ratio = F.try_divide(amount, market_cap)
    steps = F.when(market_cap.isNull() | (market_cap <= 0), 0)
    for least, points in RATIO_STEPS:
        steps = steps.when(ratio >= least, points)
    return steps.otherwise(RATIO_REST)


def sector_points(naics: Column) -> Column:
    code = F.coalesce(naics, F.lit(""))
    return F.when(code.isin(*HOT_SECTORS), WEIGHTS["hot_sector"]).when(code.startswith(WIDE_SECTOR), WIDE_POINTS).otherwise(0)


def agency_points(first_win: Column, known: Column | None = None) -> Column:
    """Explicit flag, else membership of the agency in the company's history (known), else 0."""
    points = WEIGHTS["first_agency"]
    out = F.when(first_win.isNotNull(), F.when(first_win, points).otherwise(0))
    return (out.when(known.isNotNull(), F.when(~known, points).otherwise(0)) if known is not None else out).otherwise(0)


def press_points(has_press: Column) -> Column:
    """Only a confirmed absence of news counts; unknown gives nothing."""
    return F.when(has_press.eqNullSafe(F.lit(False)), WEIGHTS["no_pr"]).otherwise(0)


def score(amount: Column, market_cap: Column, sole_source: Column, first_win: Column, naics: Column, has_press: Column, threshold: Column | int, known: Column | None = None) -> Column:
    """struct of the factors' points, ratio_pct, total, threshold and passed."""
    value, sole = ratio_points(amount, market_cap), F.when(sole_source, WEIGHTS["sole_source"]).otherwise(0)
    agency, sector, press = agency_points(first_win, known), sector_points(naics), press_points(has_press)
    total = value + sole + agency + sector + press
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    ratio = F.when(market_cap > 0, F.round(F.try_divide(amount, market_cap) * 100, 2)).otherwise(0.0)
    return F.struct(value.alias("value_to_mcap"), ratio.alias("ratio_pct"), sole.alias("sole_source"), agency.alias("first_agency"), sector.alias("hot_sector"), press.alias("no_pr"), total.alias("total"), limit.alias("threshold"), (total >= limit).alias("passed"))
