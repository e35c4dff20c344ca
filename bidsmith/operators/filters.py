"""Verdicts: ordered reject rules, the first that fails gives the reason. One CASE each, no joins inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidsmith.config import CONFIDENCE, DEFAULT, Config
from bidsmith.functions.cleaning import missing, money, signed_days, whole


def first_failure(rules: list[tuple[Column, Column | str]]) -> Column:
    """The reason of the first rule that holds; null where none does. A null condition doesn't hold."""
    out = None
    for holds, reason in rules:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        out = F.when(holds, reason) if out is None else out.when(holds, reason)
    return out.otherwise(F.lit(None).cast("string"))


def dollars(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 0))


def millions(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_string("%.0f", c / 1e6), F.lit("M"))


def live_verdict(awards: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """awards with reason and passed.

    Needs is_idiq, award_amount, awardee_name, market_cap, and the flags recent_8k, has_press and
    dilutive, which joins have set before (a verdict never triggers a join per row).
    """
    rules = [
        (F.col("is_idiq"), "IDIQ contract"),
        (F.col("award_amount") < config.min_award, F.concat(F.lit("Contract value "), dollars(F.col("award_amount")), F.lit(" below "), dollars(F.lit(config.min_award)), F.lit(" minimum"))),
        (F.col("market_cap").isNull(), F.concat(F.lit("Could not determine market cap for '"), F.col("awardee_name"), F.lit("'"))),
        (F.col("market_cap") > config.max_market_cap, F.concat(F.lit("Market cap "), dollars(F.col("market_cap")), F.lit(" exceeds "), dollars(F.lit(config.max_market_cap)), F.lit(" limit"))),
        (F.col("recent_8k"), "Recent 8-K filing found (contract likely already disclosed)"),
        (F.col("has_press"), "Press release already exists"),
        (F.col("dilutive"), "Dilutive equity offering (S-1/S-3) in progress"),
    ]
    return awards.withColumn("reason", first_failure(rules)).withColumn("passed", F.col("reason").isNull())


def meets(confidence: Column, least: str) -> Column:
    """Whether a label is at least the least one; unknown labels aren't."""
    ladder = F.array(*map(F.lit, CONFIDENCE))
    at = F.coalesce(F.array_position(ladder, confidence), F.lit(0))
    return (at > 0) & (at >= CONFIDENCE.index(least) + 1)


def press_state(has_pr: Column, days: Column, window: int) -> Column:
    """True, false or null: news within the window, confirmed outside it, or unknown."""
    unknown = F.coalesce(F.trim(has_pr), F.lit("")).isin("unknown", "None", "nan", "")
    return F.when(unknown | days.isNull(), F.lit(None).cast("boolean")).otherwise(days.between(0, window))


def training_verdict(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Training rows (all text) with reason, passed, market_cap, has_press and prior_wins."""
    days_8k, days_dilutive = signed_days("posted_date", "first_8k_date"), signed_days("last_dilutive_filing_date", "posted_date")
    confidence = F.coalesce(missing("ticker_confidence"), F.lit("none"))
    cap = F.coalesce(missing("historical_market_cap_approx").try_cast("double"), F.lit(0.0))
    amount = money("award_amount")
    rules = [
        (amount < config.min_award, F.concat(F.lit("Contract "), dollars(amount), F.lit(" below minimum"))),
        (~meets(confidence, config.least_confidence), F.concat(F.lit("Ticker confidence '"), confidence, F.lit(f"' below minimum '{config.least_confidence}'"))),
        (cap <= 0, "No historical market cap data"),
        (cap > config.max_market_cap, F.concat(F.lit("Historical market cap "), millions(cap), F.lit(" exceeds "), millions(F.lit(config.max_market_cap)), F.lit(" limit"))),
        (days_8k.between(0, config.filing_window_days), F.concat(F.lit("8-K filed "), days_8k.cast("string"), F.lit(f"d after award (within {config.filing_window_days}d window)"))),
        (days_dilutive.between(0, config.dilution_window_days), F.concat(F.lit("Dilutive offering "), days_dilutive.cast("string"), F.lit(f"d before award (within {config.dilution_window_days}d window)"))),
    ]
    press = press_state(F.col("has_pr"), signed_days("posted_date", "first_pr_date"), config.press_window_days)
    return rows.withColumns({"reason": first_failure(rules), "market_cap": cap, "has_press": press, "prior_wins": whole("agency_prior_win_count")}).withColumn("passed", F.col("reason").isNull())


def bulk_scan(records: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Rows of a bulk report that are domestic, no umbrella contracts, and of a size in range."""
    country = F.upper(F.trim("country_of_incorporation"))
    return records.where((country == "USA") & (F.trim(F.coalesce("idv_type", F.lit(""))) == "") & F.col("award_amount").between(config.min_award, config.max_award))


def funnel(verdicts: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """Rows and share (percent) of each stage's condition, in one pass."""
    n = F.count("*")
    row = verdicts.agg(*(F.count_if(c).alias(k) for k, c in stages.items()), n.alias("_n"))
    pairs = F.array(*(F.struct(F.lit(k).alias("stage"), F.col(k).alias("n"), F.round(F.try_divide(F.col(k) * 100.0, F.col("_n")), 2).alias("pct")) for k in stages))
    return row.select(F.inline(pairs))


def lookup_verdict(awards: DataFrame, known: DataFrame, asked: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """awards with passed, reason, and the ticker and market cap that decided, by the rules of a backtest with lookups.

    A ticker and a market cap (neither blank nor 0) on the award itself are a shortcut. Else the name is looked up in known
    (awardee_name, ticker, market_cap: what earlier runs found; a null ticker is a remembered failure), then in asked, the
    answers of the service; a name without either has no ticker.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    short = ~blank("ticker") & (F.coalesce("market_cap", F.lit(0.0)) != 0)
    memo = lambda df, p: df.select("awardee_name", F.lit(True).alias(f"_{p}"), F.col("ticker").alias(f"_{p}_ticker"), F.col("market_cap").alias(f"_{p}_cap"))
    df = awards.join(memo(known, "known"), "awardee_name", "left").join(memo(asked, "asked"), "awardee_name", "left").withColumn("_short", short)
    given = lambda c, own: F.when(F.col("_short"), F.col(own)).when(F.col("_known"), F.col(f"_known_{c}")).otherwise(F.col(f"_asked_{c}"))
    df = df.withColumns({"ticker": given("ticker", "ticker"), "market_cap": given("cap", "market_cap")})
    none = F.concat(F.lit("No tradeable ticker for '"), F.col("awardee_name"), F.lit("'"))
    reason = first_failure([
        (F.col("is_idiq"), "IDIQ contract"),
        (F.col("award_amount") < config.min_award, F.concat(F.lit("Contract "), dollars(F.col("award_amount")), F.lit(" below minimum"))),
        (F.col("ticker").isNull() & F.col("_known"), F.concat(none, F.lit(" (cached)"))),
        (F.col("ticker").isNull(), none),
        (F.col("market_cap") > config.max_market_cap, F.concat(F.lit("Market cap "), millions(F.col("market_cap")), F.lit(" exceeds "), millions(F.lit(config.max_market_cap)), F.lit(" limit"))),
    ])
    df = df.withColumn("reason", reason).withColumn("passed", F.col("reason").isNull())
    passed = F.when(F.col("_short"), "Passed filters (watchlist mode)").otherwise("Passed filters (backtest mode)")
    return df.withColumn("reason", F.coalesce("reason", passed)).drop("_short", *(f"_{p}{c}" for p in ("known", "asked") for c in ("", "_ticker", "_cap")))


def remembered(awards: DataFrame, known: DataFrame, asked: DataFrame) -> DataFrame:
    """The memo after a run: what it held, and for each name it lacked the service's answer, a failure (null ticker) too."""
    new = awards.select("awardee_name").distinct().join(known, "awardee_name", "left_anti").join(asked, "awardee_name", "left")
    return known.unionByName(new.select(*known.columns))


def watchlist_parse(raw: DataFrame) -> DataFrame:
    """Watchlist records with a positive amount; unlike in the general parse, a blank name stays."""
    amount = F.coalesce("amount", F.lit("0")).try_cast("double")
    return raw.withColumns({"awardee_name": F.trim(F.coalesce("awardee_name", F.lit(""))), "award_amount": amount}).where(F.col("award_amount") > 0)
